"""Tables whose columns have identities, so that a change of the schema writes no data.

Files hold columns by number (`c1`, `c2`), and each version says which name and type a number has. A rename is another name, a
wider type is read from the narrower files as they lie, a dropped column is named no more, and one that is added again under
its name has another number: what was dropped doesn't come back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators.store import Store

#: Types that each type may become, besides decimals.
WIDER = {"tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp_ntz",)}


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of the old type is one of the new, and files of the old can be read as the new."""
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return new.simpleString() in WIDER.get(old.simpleString(), ())


@dataclass
class Columns:
    """A table of a store with column identities."""

    store: Store
    name: str

    def _now(self) -> tuple[T.StructType, dict[str, str], int]:
        """The schema of the files, the name of each of its columns, and the number that a new column gets."""
        now = self.store.current(self.name)
        return self.store.schema(now), now["columns"], now["next"]

    def schema(self) -> T.StructType:
        files, names, _ = self._now()
        return T.StructType([T.StructField(names[f.name], f.dataType) for f in files])

    def _publish(self, files: T.StructType, names: dict[str, str], following: int, rows: DataFrame | None = None) -> int:
        if len(set(names.values())) < len(names):
            raise ValueError(f"{self.name}: a name is given twice in {sorted(names.values())}")
        return self.store.publish(self.name, files, rows, {"columns": names, "next": following})

    def create(self, rows: DataFrame) -> int:
        names = {f"c{k}": c for k, c in enumerate(rows.columns, 1)}
        return self._publish(T.StructType([T.StructField(c, f.dataType) for c, f in zip(names, rows.schema)]), names, len(names) + 1, rows.toDF(*names))

    def append(self, rows: DataFrame) -> int:
        """Adds rows; columns that they lack are null, and one that the table lacks, or of another type than a narrower one, is an error."""
        files, names, following = self._now()
        held = {names[f.name]: f for f in files}
        for f in rows.schema:
            if f.name not in held or f.dataType != held[f.name].dataType and not widens(f.dataType, held[f.name].dataType):
                raise ValueError(f"{self.name} has no column {f.name} of {f.dataType.simpleString()}")
        there = [(F.col(names[f.name]) if names[f.name] in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in files]
        return self._publish(files, names, following, rows.select(*there))

    def rename(self, old: str, new: str) -> int:
        files, names, following = self._now()
        return self._publish(files, {c: new if n == self._own(names, old) else n for c, n in names.items()}, following)

    def widen(self, column: str, kind: T.DataType) -> int:
        files, names, following = self._now()
        self._own(names, column)
        for f in files:
            if names[f.name] == column and not widens(f.dataType, kind):
                raise ValueError(f"{self.name}: {column} can't become {kind.simpleString()}")
        return self._publish(T.StructType([T.StructField(f.name, kind if names[f.name] == column else f.dataType) for f in files]), names, following)

    def drop(self, column: str) -> int:
        files, names, following = self._now()
        self._own(names, column)
        return self._publish(T.StructType([f for f in files if names[f.name] != column]), {c: n for c, n in names.items() if n != column}, following)

    def add(self, column: str, kind: T.DataType) -> int:
        files, names, following = self._now()
        return self._publish(T.StructType([*files, T.StructField(f"c{following}", kind)]), {**names, f"c{following}": column}, following + 1)

    def sync(self, schema: T.StructType, follow: bool = False) -> list[str]:
        """Adds the columns that the table lacks, widens those that are wider now, and (with follow) drops the others; what was done."""
        done = []
        for f in schema:
            own = {g.name: g.dataType for g in self.schema()}.get(f.name)
            if own is None:
                self.add(f.name, f.dataType)
                done.append(f"added:{f.name}")
            elif own != f.dataType and not widens(f.dataType, own):
                self.widen(f.name, f.dataType)
                done.append(f"widened:{f.name}")
        for c in [c for c in self.schema().names if follow and c not in schema.names]:
            self.drop(c)
            done.append(f"dropped:{c}")
        return done

    def read(self) -> DataFrame:
        files, names, _ = self._now()
        rows = self.store.scan(self.name, self.store.current(self.name), self.store.current(self.name)["folders"])
        return rows.select(*[F.col(f.name).alias(names[f.name]) for f in files])

    def _own(self, names: dict[str, str], column: str) -> str:
        if column not in names.values():
            raise ValueError(f"{self.name} has no column {column}")
        return column
