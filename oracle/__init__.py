"""Plain-SQL statements of every registered query, written independently of the engine.

The statements work row by row at student grain, with windows and distinct rows,
so that they share no plan shape with the engine's aggregate-first design.
"""

from oracle.statements import statements

__all__ = ["statements"]
