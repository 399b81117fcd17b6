"""Risk gate over decisions: a session of counters for each trading day, whose verdicts hang on what earlier ones made.

Decisions are rows of (symbol, t, close, choice, confidence, volatile): choice is
1 to buy, -1 to sell, 0 to hold, NULL for none. A session begins with its key,
so sessions are folded side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold

#: Rules by their code in the fold: name, verdict, reason.
RULES = [
    ("flat", "veto", "flat choice"), ("max_follow_day", "veto", "follow cap reached"), ("profit_protect", "veto", "profit is protected"), ("consec_loss_stop", "veto", "stopped by losses in a row"),
    ("volatile", "reduce", "volatile environment"), ("reduce", "reduce", "confidence under 0.85"), ("reduce", "reduce", "two losses in a row"), ("full", "approve", "strong signal"),
]
FIELDS = ["verdict", "lots", "reason", "rule", "outcome"]


class Session:
    """Code of the rule, lots, and the points that the position before made when this row closed it."""

    outputs = 3

    def __init__(self, cap: int = 5, protect: float = 800.0):
        self.cap, self.protect, self.followed = cap, protect, {}
        self.realized, self.losses, self.protected, self.open = 0.0, 0, False, None

    def _close(self, close):
        if self.open is None:
            return None
        way, entry, lots = self.open
        self.open, points = None, way * (close - entry)
        self.realized += points * lots
        self.losses = 0 if points >= 0 else self.losses + 1
        self.protected = self.protected or self.realized >= self.protect
        return points

    def _rule(self, choice, confidence, volatile, part) -> int:
        if choice == 0:
            return 0
        if self.followed.get(part, 0) >= self.cap:
            return 1
        if self.protected and choice is not None:
            return 2
        if self.losses >= 3:
            return 3
        if volatile:
            return 4
        if confidence is None or confidence < 0.85:
            return 5
        return 6 if self.losses == 2 else 7

    def step(self, close, choice, confidence, volatile, part):
        points = self._close(close)
        rule = self._rule(choice, confidence, volatile, part)
        lots = 0.0 if rule < 4 else 0.5 if rule < 7 else 1.0
        if lots and choice is not None:
            self.followed[part] = self.followed.get(part, 0) + 1
            self.open = choice, close, lots
        return float(rule), lots, points


def gate(decisions: DataFrame, session: Column, part: Column, cap: int = 5, protect: float = 800.0) -> DataFrame:
    """Adds verdict, lots, reason, rule and outcome. Counters begin anew with each ``session`` of a symbol; the cap holds for each ``part`` of it (0 or 1)."""
    columns = decisions.columns
    rows = decisions.withColumns({"_session": F.concat_ws("|", "symbol", session.cast("string")), "_part": part.cast("int"), "_volatile": F.coalesce(F.col("volatile").cast("int"), F.lit(0))})
    out = fold(rows, [(["_code", "lots", "outcome"], lambda: Session(cap, protect), ["close", "choice", "confidence", "_volatile", "_part"])], key="_session")
    of = lambda k: F.get(F.array(*[F.lit(r[k]) for r in RULES]), F.col("_code").cast("int"))
    return out.select(*columns, of(1).alias("verdict"), "lots", of(2).alias("reason"), of(0).alias("rule"), "outcome")


def differences(old: DataFrame, new: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(kind, name, changed, rows): how many rows differ in each field, and by group in any field; rows that both have, NULL being a value of its own."""
    both = new.select(*keys, group, *FIELDS).join(old.select(*keys, *[F.col(f).alias(f"_old_{f}") for f in FIELDS]), keys)
    differs = [~F.col(f).eqNullSafe(F.col(f"_old_{f}")) for f in FIELDS]
    anything = F.array_contains(F.array(*differs), True)
    marks = [F.struct(F.lit("field").alias("kind"), F.lit(f).alias("name"), d.alias("differs")) for f, d in zip(FIELDS, differs, strict=True)] + [F.struct(F.lit("group").alias("kind"), F.col(group).alias("name"), anything.alias("differs"))]
    return both.select(F.explode(F.array(*marks)).alias("m")).groupBy("m.kind", "m.name").agg(F.count(F.when(F.col("m.differs"), 1)).alias("changed"), F.count("*").alias("rows"))
