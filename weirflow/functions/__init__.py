"""Functions of the expression language, each a column built from columns; see ``registry``."""

from . import array, codec, convert, ip, number, parse, string, system, time  # noqa: F401  they register themselves
from .registry import FUNCTIONS, call  # noqa: F401
