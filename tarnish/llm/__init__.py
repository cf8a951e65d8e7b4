"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage: it can be removed and
the rest keeps working.  Each operator module has a general interface;
``queries`` binds them to the sample tables.
"""
