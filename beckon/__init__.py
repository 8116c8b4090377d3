"""beckon: customer-engagement analytics as lazy Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (usable through
``df.transform``) or a ``Column`` expression.  Time is always the ``as_of``
parameter, never the wall clock, so results are reproducible.
"""
