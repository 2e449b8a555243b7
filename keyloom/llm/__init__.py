"""Training-data operators over document tables.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` binds them to the production
parameters of the registered queries.
"""
