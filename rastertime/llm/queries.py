"""The registered queries opN_<name> of the corpus operators and, where SQL can express one, the SQL for it."""

from __future__ import annotations

from rastertime.llm import op1, op10, op11, op12, op13, op2, op3, op4, op5, op6, op7, op8, op9

_ALL = [op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13]
QUERIES = {m.NAME: m.query for m in _ALL}
ORACLES = {m.NAME: m.ORACLE for m in _ALL if m.ORACLE}
