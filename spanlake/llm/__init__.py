"""Training-data operators: scoring, tokenizing, searching and deduplicating a corpus of documents.

Nothing outside this subpackage imports it.  Each module holds one operator with its general interface;
``queries`` binds the operators to the driver tables and holds the SQL twins.
"""
