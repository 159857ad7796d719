"""Queries over the tables of TESTDATA.md, grouped like the operators."""

from tessera.plans import folders, formats, projects, relational, textual

MODULES = [relational, textual, projects, formats, folders]
