"""The remap language: parsed to a tree, compiled to columns."""

from .compiler import CompileError, Program, remap  # noqa: F401
from .parser import ParseError, parse  # noqa: F401
