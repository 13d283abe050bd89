"""Operators for building training corpora: one module for each operator, and the queries over them in ``registry``."""
