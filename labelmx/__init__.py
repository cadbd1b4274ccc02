"""labelmx: labeled matrices on Spark DataFrames."""

from .model import Categories, Graph, LabeledMatrix, Matrix, Raw, SparseVectors, Table, Vectors, axis_table
from .operators.build import create, from_annotation, from_compressed, from_wide
from .operators.by_values import ByValues
from .operators.concat import concat, concatenate
from .session import tune

__all__ = [
    "ByValues", "Categories", "Graph", "LabeledMatrix", "Matrix", "Raw", "SparseVectors", "Table", "Vectors", "axis_table",
    "create", "from_annotation", "from_compressed", "from_wide", "concat", "concatenate", "tune",
]
