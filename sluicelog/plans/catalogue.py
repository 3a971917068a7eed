"""The modules that register queries."""

from . import analytics, logs, problems, surface

MODULES = [problems, analytics, surface, logs]
