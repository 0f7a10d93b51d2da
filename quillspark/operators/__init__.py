"""Every operator, by module of its subject. Importing the package collects them in OPERATORS."""

from quillspark.operators import curriculum, layout, practice, relational, scoring, strokes, text
from quillspark.operators.base import OPERATORS, Operator, operator

__all__ = ["OPERATORS", "Operator", "operator", "curriculum", "layout", "practice", "relational", "scoring", "strokes", "text"]
