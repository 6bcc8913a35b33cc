from lakehook.functions import predicates, scalars  # noqa: F401
