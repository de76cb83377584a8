"""Edit costs in sixteenths of an ordinary edit, and the masks that bound them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import neighbours

UNIT = 16
MAX_QUERY = 128


@dataclass(frozen=True)
class CostModel:
    """Costs of edits; those at a query's first symbol are `first` quarters as dear."""

    layout: str = "qwerty"
    sub: int = 16
    sub_adjacent: int = 8
    indel: int = 16
    indel_double: int = 8
    transpose: int = 12
    first: int = 6

    def __post_init__(self):
        neighbours(self.layout)

    @classmethod
    def qwerty(cls) -> CostModel:
        return cls()

    @classmethod
    def for_layout(cls, layout: str) -> CostModel:
        return cls(layout)

    def at(self, cost: int, position: int) -> int:
        return cost * self.first // 4 if position == 0 else cost

    def sub_cost(self, q: str, t: str, position: int) -> int:
        return 0 if q == t else self.at(self.sub_adjacent if (q, t) in neighbours(self.layout) else self.sub, position)

    def del_cost(self, query: str, position: int) -> int:
        """Of leaving out the query's symbol there; beyond its end the plain cost."""
        if position >= len(query):
            return self.indel
        return self.at(self.indel_double if position > 0 and query[position] == query[position - 1] else self.indel, position)

    def ins_cost(self, t: str, before: str | None, position: int) -> int:
        """Of a term's symbol that the query lacks, after so many of the query's."""
        return self.at(self.indel_double if t == before else self.indel, position)

    def transpose_cost(self, position: int) -> int:
        return self.at(self.transpose, position)

    @property
    def c_min(self) -> int:
        return min(self.sub, self.sub_adjacent, self.indel, self.indel_double, self.transpose)

    @property
    def c_indel_min(self) -> int:
        return min(self.indel, self.indel_double)

    @property
    def c_transpose_min(self) -> int:
        return self.transpose

    @property
    def max_budget(self) -> int:
        return 8 * self.c_indel_min


def whole_units(cost: Column) -> Column:
    """Costs rounded up to whole edits."""
    return F.ceil(cost / UNIT).cast("int")


def symbol_mask(text: str) -> Column:
    """64 classes of a text's code points as bits: ASCII by its six low bits, all
    others in 38 classes that no small letter has. Equal symbols have equal classes."""
    return F.expr(f"""aggregate(filter(split({text}, ''), c -> c <> ''), 0L, (a, c) -> a | shiftleft(1L,
        IF(ascii(c) < 128, ascii(c) & 63, ascii(c) % 38 + IF(ascii(c) % 38 < 33, 0, 26))))""")


def _class(c: str) -> int:
    n = ord(c)
    return n & 63 if n < 128 else n % 38 + (0 if n % 38 < 33 else 26)


def symbol_parts(text: str, cm: CostModel) -> Column:
    """Of a text's distinct symbols: their class, and the classes of the keys that
    touch them, as bits."""
    near: dict[str, int] = {}
    for a, b in neighbours(cm.layout):
        near[a] = near.get(a, 0) | 1 << _class(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.create_map(*[F.lit(x) for a, m in sorted(near.items()) for x in (a, signed(m))])
    symbols = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    code = lambda c: F.when(F.ascii(c) < 128, F.ascii(c).bitwiseAND(63)).otherwise(F.ascii(c) % 38 + F.when(F.ascii(c) % 38 < 33, 0).otherwise(26))
    return F.transform(symbols, lambda c: F.struct(F.call_function("shiftleft", F.lit(1).cast("long"), code(c).cast("int")).alias("own"), F.coalesce(masks[c], F.lit(0).cast("long")).alias("near")))


def least_cost(parts: str, mask: str, cm: CostModel) -> Column:
    """A bound on the cost of a pair: every symbol that the other text lacks has to
    be left out or replaced, cheaply only by a key that touches it and that the
    other text has. The first of equal symbols is never a doubled one."""
    dear = min(cm.sub, cm.indel)
    cheap = min(dear, cm.sub_adjacent)
    return F.expr(f"aggregate({parts}, 0, (s, x) -> s + IF({mask} & x.own <> 0, 0, IF({mask} & x.near <> 0, {cheap}, {dear})))")
