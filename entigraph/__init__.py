"""Typed entity graphs and text corpora as Spark DataFrames."""

from entigraph.graph import TypedGraph
from entigraph.model import ClassDef, Slot, TypeRegistry

__all__ = ["ClassDef", "Slot", "TypeRegistry", "TypedGraph"]
