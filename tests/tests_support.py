from test_sources import IFC, OBJ  # noqa: F401
