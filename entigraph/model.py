"""Classes, slots and inheritance: declared in Python, used as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Literal ranges and the column type of each; any other range is the name of a class, and the slot a reference.
LITERALS: dict[str, T.DataType] = {
    "string": T.StringType(), "keyword": T.StringType(), "symbol": T.StringType(), "uri": T.StringType(), "uuid": T.StringType(),
    "boolean": T.BooleanType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bigint": T.DecimalType(38, 0),
    "bigdec": T.DecimalType(38, 18), "instant": T.TimestampType(), "bytes": T.BinaryType(),
}


@dataclass(frozen=True)
class Slot:
    name: str
    range: str = "string"
    many: bool = False
    required: bool = False
    fulltext: bool = False
    unique: bool = False

    @property
    def is_ref(self) -> bool:
        return self.range not in LITERALS

    @property
    def type(self) -> T.DataType:
        one = LITERALS.get(self.range, T.StringType())
        return T.ArrayType(one) if self.many else one


@dataclass(frozen=True)
class ClassDef:
    name: str
    parents: tuple[str, ...] = ()
    slots: tuple[Slot, ...] = ()
    abstract: bool = False
    weights: dict[str, float] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    format: str | None = None


class TypeRegistry:
    """Slot names are unique over all classes: a name has one declaration, which several classes may share."""

    def __init__(self, classes: Iterable[ClassDef] = ()) -> None:
        self.classes: dict[str, ClassDef] = {}
        self.slots: dict[str, Slot] = {}
        self.domains: dict[str, str] = {}
        for c in classes:
            self.add(c)

    def add(self, c: ClassDef) -> None:
        for p in c.parents:
            if p not in self.classes:
                raise ValueError(f"{c.name}: its parent {p} is not declared yet")
        for s in c.slots:
            if self.slots.setdefault(s.name, s) != s:
                raise ValueError(f"{c.name}: slot {s.name} is declared otherwise elsewhere")
            self.domains.setdefault(s.name, c.name)
        self.classes[c.name] = c

    def ancestors(self, name: str) -> list[str]:
        """Nearest first, without the class itself."""
        out, queue = [], list(self.classes[name].parents)
        while queue:
            p = queue.pop(0)
            if p not in out:
                out.append(p)
                queue += self.classes[p].parents
        return out

    def descendants(self, name: str) -> list[str]:
        return [c for c in self.classes if name in self.ancestors(c)]

    def family(self, name: str) -> list[str]:
        """The class and all below it."""
        return [name, *self.descendants(name)]

    def slots_of(self, name: str) -> list[Slot]:
        """Own and inherited."""
        return list({s.name: s for c in [name, *self.ancestors(name)] for s in self.classes[c].slots}.values())

    def weights_of(self, name: str) -> dict[str, float]:
        for c in [name, *self.ancestors(name)]:
            if self.classes[c].weights:
                return self.classes[c].weights
        return {}

    def struct_of(self, name: str) -> T.StructType:
        fields = [T.StructField("id", T.StringType(), False), T.StructField("ident", T.StringType()), T.StructField("class", T.StringType(), False)]
        return T.StructType(fields + [T.StructField(s.name, s.type, True, {"ref": s.range} if s.is_ref else {}) for s in self.slots_of(name)])

    def class_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.abstract, list(c.parents), [s.name for s in c.slots]) for c in self.classes.values()]
        return spark.createDataFrame(rows, "class string, abstract boolean, subclass_of array<string>, slots array<string>")

    def property_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s.name, self.domains[s.name], s.range, "many" if s.many else "one", s.required, s.fulltext, s.unique, s.is_ref) for s in self.slots.values()]
        return spark.createDataFrame(rows, "slot string, domain string, range string, cardinality string, required boolean, fulltext boolean, unique boolean, is_ref boolean")
