"""Lexers, grammars and the operator that finds source files which do not parse."""
