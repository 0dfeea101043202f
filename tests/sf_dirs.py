"""Folders of the given tables (a module with a name of its own: several
``conftest.py`` files can be loaded, so none of them may be imported)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
