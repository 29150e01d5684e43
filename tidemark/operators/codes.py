"""Code books: event code -> feature, unit conversion and valid range."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.session import small_frame


@dataclass(frozen=True)
class Code:
    """One event code. The feature value is ``(raw - offset) * scale``."""

    code: int | str
    feature: str
    offset: float = 0.0
    scale: float = 1.0

    @property
    def converts(self) -> bool:
        return self.offset != 0.0 or self.scale != 1.0


@dataclass(frozen=True)
class CodeBook:
    """Codes in order of precedence (the first entry of a code wins) and inclusive ranges."""

    codes: Sequence[Code]
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def entries(self) -> list[Code]:
        first: dict = {}
        for entry in self.codes:
            first.setdefault(entry.code, entry)
        return list(first.values())

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(entry.feature for entry in self.entries))

    def _looked_up(self, code: str, of: Callable[[Code], object]) -> Column:
        """What ``of`` gives for the entry of each event's code; null for unknown codes."""
        if not self.entries:
            raise ValueError("empty code book")
        pairs = [F.lit(x) for e in self.entries for x in (e.code, of(e))]
        return F.try_element_at(F.create_map(*pairs), F.col(code))

    def feature_of(self, code: str) -> Column:
        """Feature name of a code column, null for unknown codes."""
        return self._looked_up(code, lambda e: e.feature)

    def converted(self, code: str, value: str) -> Column:
        """Value in the feature's unit; codes without a conversion pass through untouched."""
        known = self._looked_up(code, lambda e: e.converts)
        offset, scale = (self._looked_up(code, lambda e, k=k: float(getattr(e, k))) for k in ("offset", "scale"))
        return F.when(known, (F.col(value) - offset) * scale).otherwise(F.col(value))

    def in_range(self, feature: str = "feature", value: str = "value") -> Column:
        """Both ends inclusive; features without a range pass, unknown features do not."""
        infinite = (float("-inf"), float("inf"))
        ends = [F.lit(x) for f in self.features for x in (f, [float(v) for v in self.ranges.get(f, infinite)])]
        known = F.try_element_at(F.create_map(*ends), F.col(feature))
        return F.col(value).between(F.get(known, F.lit(0)), F.get(known, F.lit(1)))

    def as_frame(self, spark) -> DataFrame:
        """The book as a table (code, feature, offset, scale, lo, hi)."""
        text = any(isinstance(e.code, str) for e in self.entries)
        schema = T.StructType([
            T.StructField("code", T.StringType() if text else T.LongType(), False),
            T.StructField("feature", T.StringType(), False),
            T.StructField("offset", T.DoubleType(), False),
            T.StructField("scale", T.DoubleType(), False),
            T.StructField("lo", T.DoubleType(), True),
            T.StructField("hi", T.DoubleType(), True),
        ])
        rows = []
        for e in self.entries:
            low, high = self.ranges.get(e.feature, (None, None))
            rows.append((e.code, e.feature, float(e.offset), float(e.scale), low, high))
        return small_frame(spark, rows, schema)


def normalise_events(
    events: DataFrame,
    book: CodeBook,
    code: str = "itemid",
    value: str = "valuenum",
    apply_ranges: bool = True,
) -> DataFrame:
    """Events of known codes with a value, as ``feature`` and ``value`` in feature units.

    The code list and the not-null test stay plain predicates on source columns, so they
    reach the Parquet scan. Rows outside the valid range are dropped. The book is joined as a table; it is
    built on the driver, so its size is known.
    """
    known = events.where(F.col(code).isin([e.code for e in book.entries])).where(F.col(value).isNotNull())
    kept = [c for c in events.columns if c not in (code, value, "feature", "value")]
    table = F.broadcast(book.as_frame(events.sparkSession).alias("book"))
    raw = F.col(f"events.{value}")
    converts = (F.col("book.offset") != 0.0) | (F.col("book.scale") != 1.0)
    moved = (raw - F.col("book.offset")) * F.col("book.scale")
    mapped = known.alias("events").join(table, F.col(f"events.{code}") == F.col("book.code")).select(
        *[F.col(f"events.{c}") for c in kept],
        F.col("book.feature").alias("feature"),
        F.when(converts, moved).otherwise(raw).cast("double").alias("value"),
        F.col("book.lo").alias("__lo"),
        F.col("book.hi").alias("__hi"),
    )
    if apply_ranges:
        inside = F.col("value").between(F.col("__lo"), F.col("__hi"))
        mapped = mapped.where(F.col("__lo").isNull() | inside)
    return mapped.drop("__lo", "__hi")
