"""Forward-looking labels: value, validity and reason for every panel row.

A recipe only states which prices it needs at which trading-day offsets and how to turn
them into a label. `build_targets` fetches all offsets of all recipes with exact
RANGE frames over one window (partitioned by instrument, ordered by td_idx), so any
number of targets costs one shuffle and one sort of the pruned columns. Keys are unique,
so a window group is never longer than the calendar.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from panelwright.functions.missing import is_missing
from panelwright.functions.schema import SchemaError, require_columns
from panelwright.operators.panel import instrument_series, meta_struct, series_days, series_rows, status_struct

PriceAt = Callable[[str, int], Column]


@dataclass(frozen=True)
class CalendarPosition:
    """Where a row stands on the trading-time axis."""

    td_idx: Column
    n_days: Column

    def known(self) -> Column:
        return self.td_idx.isNotNull()

    def reaches(self, offset: int) -> Column:
        target = self.td_idx + F.lit(offset)
        return (target >= 0) & (target < self.n_days)


def _bad_price(price: Column) -> Column:
    return is_missing(price) | (price <= 0)


def _label(value: Column, valid: Column, reason: Column) -> Column:
    return F.struct(
        F.when(valid, value).cast("float").alias("value"), valid.alias("valid"), reason.alias("reason")
    )


class Recipe:
    """Extension point: subclass, then `register_target`."""

    name: str

    def required_columns(self) -> list[str]:
        raise NotImplementedError

    def offsets(self) -> list[tuple[str, int]]:
        """(column, trading-day offset) pairs the label reads."""
        raise NotImplementedError

    def extra_columns(self) -> dict[str, Column]:
        """Further window columns the label needs, by private name."""
        return {}

    def reason(self, at: PriceAt, position: CalendarPosition) -> Column:
        """Why the row has no label; empty text where it has one."""
        raise NotImplementedError

    def value(self, at: PriceAt) -> Column:
        """The label, evaluated only where it is valid."""
        raise NotImplementedError

    def valid(self, reason: Column) -> Column:
        return reason == ""

    def class_names(self) -> dict[int, str]:
        return {}

    def validate_inputs(self, panel: DataFrame) -> None:
        require_columns(panel, self.required_columns(), f"panel for target {self.name}")


def parse_formula(formula: str) -> tuple[str, int, str, int]:
    m = re.fullmatch(r"([oc])(\d+)([oc])(\d+)", formula.strip().lower())
    if not m:
        raise ValueError(f"return formula {formula!r} is not of the form o1c2")
    return m[1], int(m[2]), m[3], int(m[4])


class ReturnRecipe(Recipe):
    """Return from an entry price to an exit price, each open or close at a day offset."""

    def __init__(
        self,
        name: str,
        formula: str | None = None,
        open_col: str = "market.open",
        close_col: str = "market.close",
        window: int | None = None,
        price_col: str | None = None,
    ):
        if formula is None and window is None:
            raise ValueError("a return needs a formula or a window")
        self.name = name
        entry, self.entry_day, exit_, self.exit_day = parse_formula(formula if formula is not None else f"c0c{window}")
        columns = {"o": open_col, "c": price_col or close_col}
        self.entry_col, self.exit_col = columns[entry], columns[exit_]

    def required_columns(self) -> list[str]:
        return sorted({self.entry_col, self.exit_col})

    def offsets(self) -> list[tuple[str, int]]:
        return [(self.entry_col, self.entry_day), (self.exit_col, self.exit_day)]

    def reason(self, at: PriceAt, position: CalendarPosition) -> Column:
        # An entry day past the calendar end is reported as "insufficient_history".
        return (
            F.when(~position.known(), "not_in_calendar")
            .when(~position.reaches(self.entry_day), "insufficient_history")
            .when(~position.reaches(self.exit_day), "insufficient_forward")
            .when(_bad_price(at(self.entry_col, self.entry_day)), "missing_entry_price")
            .when(_bad_price(at(self.exit_col, self.exit_day)), "missing_exit_price")
            .otherwise("")
        )

    def value(self, at: PriceAt) -> Column:
        entry, exit_ = at(self.entry_col, self.entry_day), at(self.exit_col, self.exit_day)
        return F.try_divide(exit_ - entry, entry)


# Momentum classes.
MOMENTUM_CLASSES = {
    0: "Sink (正→负)",
    1: "Negative (全负)",
    2: "Volatile (震荡)",
    3: "Positive (全正)",
    4: "Bounce (负→正)",
}


def momentum_class(line: Column) -> Column:
    """Class of a momentum line by the sign changes between neighbours that are both non-zero.

    A zero between two signs hides the change, so [+, 0, -] has none and follows its first sign.
    """
    signs = F.transform(line, lambda m: F.signum(m))
    steps = F.zip_with(F.slice(signs, 1, F.size(line) - 1), F.slice(signs, 2, F.size(line) - 1), lambda a, b: a * b < 0)
    crossings = F.size(F.filter(steps, lambda s: s))
    nonzero = F.filter(signs, lambda s: s != 0)
    first, last = F.get(nonzero, F.lit(0)), F.get(nonzero, F.size(nonzero) - 1)
    return (
        F.when((crossings == 0) & (first > 0), 3)
        .when((crossings == 0) & (first < 0), 1)
        .when((crossings == 1) & (first < 0) & (last > 0), 4)
        .when((crossings == 1) & (first > 0) & (last < 0), 0)
        .otherwise(2)
    )


class MomentumClassRecipe(Recipe):
    """Five classes of the line close[t+k] - close[t-gap], k = 0 .. line_len-1."""

    def __init__(self, name: str, gap: int = 4, line_len: int = 7, price_col: str = "market.close"):
        self.name, self.gap, self.line_len, self.price_col = name, gap, line_len, price_col

    def required_columns(self) -> list[str]:
        return [self.price_col]

    def offsets(self) -> list[tuple[str, int]]:
        return [(self.price_col, k) for k in (-self.gap, *range(self.line_len))]

    def class_names(self) -> dict[int, str]:
        return dict(MOMENTUM_CLASSES)

    def reason(self, at: PriceAt, position: CalendarPosition) -> Column:
        bad = reduce(or_, [_bad_price(at(col, k)) for col, k in self.offsets()])
        return (
            F.when(~position.known(), "not_in_calendar")
            .when(~position.reaches(-self.gap), "insufficient_history")
            .when(~position.reaches(self.line_len - 1), "insufficient_forward_window")
            .when(bad, "missing_close_in_window")
            .otherwise("")
        )

    def value(self, at: PriceAt) -> Column:
        base = at(self.price_col, -self.gap)
        return momentum_class(F.array(*[at(self.price_col, k) - base for k in range(self.line_len)]))


class ForwardFilledReturnRecipe(ReturnRecipe):
    """As a return, but a suspended exit day uses the next day that has a price, and says so."""

    FILLED = "FORWARD_FILLED_DUE_TO_SUSPENSION"

    @property
    def _exit(self) -> str:
        return f"_{self.name}_exit"

    def extra_columns(self) -> dict[str, Column]:
        price = F.col(self.exit_col).cast("double")
        # Descending order makes "at or after t+k" a growing frame, evaluated in one pass.
        later = W.partitionBy("sid").orderBy(F.desc("td_idx")).rangeBetween(W.unboundedPreceding, -self.exit_day)
        return {self._exit: F.last(F.when(~_bad_price(price), price), ignorenulls=True).over(later)}

    def reason(self, at: PriceAt, position: CalendarPosition) -> Column:
        return (
            F.when(~position.known(), "not_in_calendar")
            .when(~position.reaches(self.entry_day), "insufficient_history")
            .when(~position.reaches(self.exit_day), "insufficient_forward")
            .when(_bad_price(at(self.entry_col, self.entry_day)), "missing_entry_price")
            .when(F.col(self._exit).isNull(), "missing_exit_price")
            .when(_bad_price(at(self.exit_col, self.exit_day)), self.FILLED)
            .otherwise("")
        )

    def valid(self, reason: Column) -> Column:
        return reason.isin("", self.FILLED)

    def value(self, at: PriceAt) -> Column:
        entry = at(self.entry_col, self.entry_day)
        return F.try_divide(F.col(self._exit) - entry, entry)


@dataclass(frozen=True)
class TargetSpec:
    name: str
    task_type: str
    family: str | None = None
    horizon: int | None = None
    dtype: str = "float32"
    params: dict = field(default_factory=dict)


_TARGETS: dict[str, tuple[type[Recipe], TargetSpec]] = {}


def register_target(recipe: type[Recipe], spec: TargetSpec) -> None:
    _TARGETS[spec.name] = (recipe, spec)


def list_targets() -> list[str]:
    return list(_TARGETS)


def target_spec(name: str) -> TargetSpec:
    if name not in _TARGETS:
        raise KeyError(f"target {name!r} is not registered; known: {list_targets()}")
    return _TARGETS[name][1]


def make_recipe(name: str, **overrides) -> Recipe:
    """The registered recipe, its default parameters overridden by the given ones."""
    spec = target_spec(name)
    return _TARGETS[name][0](name=name, **{**spec.params, **overrides})


# Built-in return targets (name, formula, horizon in trading days).
RETURN_TARGETS = (
    ("return_c0c1", "c0c1", 1),
    ("return_o1c2", "o1c2", 2),
    ("return_5d", "c0c5", 5),
    ("return_o1c5", "o1c5", 5),
    ("return_20d", "c0c20", 20),
    ("return_c1c2", "c1c2", 2),
)
for _name, _formula, _horizon in RETURN_TARGETS:
    register_target(ReturnRecipe, TargetSpec(_name, "regression", "return", _horizon, params={"formula": _formula}))
register_target(
    MomentumClassRecipe,
    TargetSpec("momentum_cls", "classification", "momentum", 7, "int16", {"gap": 4, "line_len": 7}),
)


def requested_targets(config: dict, only: str | None = None) -> list[tuple[str, dict]]:
    """(name, params) pairs from a config: a `targets` list, a single `target`, or the default 5-day return."""
    single = {"name": "return_5d", "params": {}} | config.get("target", {})
    wanted = [(t["name"], t.get("params", {})) for t in config.get("targets", [single])]
    if only is None:
        return wanted
    known = [p for p in [*wanted, (single["name"], single["params"])] if p[0] == only]
    return [*known, (only, {})][:1]


def with_trading_day(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attach td_idx by date; NULL for dates outside the calendar."""
    if "td_idx" in panel.columns:
        panel = panel.drop("td_idx")
    return panel.join(F.broadcast(calendar.select("date", "td_idx")), "date", "left")


def build_targets(panel: DataFrame, calendar: DataFrame, recipes: Iterable[Recipe], keep: Iterable[str] = ()) -> DataFrame:
    """(date, sid, <kept columns>, one label struct per recipe), one row per panel row."""
    recipes = list(recipes)
    for recipe in recipes:
        recipe.validate_inputs(panel)
    if "td_idx" not in panel.columns:
        panel = with_trading_day(panel, calendar)
    position = CalendarPosition(F.col("td_idx"), calendar.agg(F.count(F.lit(1))).scalar())
    by_sid = W.partitionBy("sid").orderBy("td_idx")

    fetched = {pair: f"_at{i}" for i, pair in enumerate(sorted({p for r in recipes for p in r.offsets()}))}
    # Prices are columns of their own before the window, so that no struct goes through it for one field. A row's own price needs no frame.
    prices = {col: f"_price{i}" for i, col in enumerate(sorted({col for col, _ in fetched}))}
    looked_up = panel.withColumns({name: F.col(col).cast("double") for col, name in prices.items()}).withColumns(
        {
            alias: _price_at(prices[col], k, by_sid)
            for (col, k), alias in fetched.items()
        }
    )
    for recipe in recipes:
        if extra := recipe.extra_columns():
            looked_up = looked_up.withColumns(extra)

    def at(col: str, k: int) -> Column:
        return F.col(fetched[col, k])

    return _labelled(looked_up, recipes, at, position, keep)


def _price_at(price: str, k: int, by_sid: WindowSpec) -> Column:
    """The price k days on. A row's own needs no frame. Keys are unique, so that the day before or after, if it is there, is the neighbouring row."""
    if k == 0:
        return F.col(price)
    if abs(k) == 1:
        return F.when(F.lead("td_idx", k).over(by_sid) == F.col("td_idx") + k, F.lead(price, k).over(by_sid))
    return F.first(price).over(by_sid.rangeBetween(k, k))


def _labelled(looked_up: DataFrame, recipes: list[Recipe], at: PriceAt, position: CalendarPosition, keep: Iterable[str]) -> DataFrame:
    # Reasons are columns of their own first: each is used three times and should be evaluated once.
    reasoned = looked_up.withColumns({f"_reason_{r.name}": r.reason(at, position) for r in recipes})
    labels = []
    for r in recipes:
        reason = F.col(f"_reason_{r.name}")
        labels.append(_label(r.value(at), r.valid(reason), reason).alias(r.name))
    return reasoned.select("date", "sid", *keep, *labels)


def series_targets(records: DataFrame, master: DataFrame, calendar: DataFrame, recipes: Iterable[Recipe], keep: Iterable[str] = ()) -> DataFrame:
    """`build_targets` of `panel.series_rows(records, master, calendar)`, read from an array of days for each instrument.

    Only records are moved and sorted. Days without one come up beside the array, and a price k days on is read k places on: no window buffers
    or sorts the days, which outnumber the records. Recipes that need more than prices at offsets go through `build_targets`.
    """
    recipes, keep = list(recipes), list(keep)
    fetched = {pair: f"_at{i}" for i, pair in enumerate(sorted({p for r in recipes for p in r.offsets()}))}
    columns = sorted({col for col, _ in fetched})
    if any(r.extra_columns() for r in recipes) or any(c.split(".")[0] not in ("market", "feature") for c in columns):
        return build_targets(series_rows(records, master, calendar), calendar, recipes, keep)
    for recipe in recipes:
        recipe.validate_inputs(records)
    prices = {col: f"_price{i}" for i, col in enumerate(columns)}
    carried = {name: F.col(col).cast("double") for col, name in prices.items()}
    if "market" in keep:
        carried["market"] = F.col("market")
    elif "status" in keep:
        carried["market"] = F.when(F.col("market").isNotNull(), F.struct("market.close"))
    if "feature" in keep:
        carried["feature"] = F.col("feature")
    if "status" in keep:
        carried["_ratio"] = F.col("_ratio")
    rows = series_days(instrument_series(records, master, calendar, carried), calendar)
    rows = rows.withColumns({alias: F.get("_days", F.col("_pos") + k)[prices[col]] for (col, k), alias in fetched.items()})
    rows = rows.withColumns({name: F.col(f"_rec.{name}") for name in ("market", "feature", "_ratio") if name in carried})
    if "status" in keep:
        rows = rows.withColumn("status", status_struct("_ratio"))
    if "meta" in keep:
        rows = rows.withColumn("meta", meta_struct())

    def at(col: str, k: int) -> Column:
        return F.col(fetched[col, k])

    return _labelled(rows, recipes, at, CalendarPosition(F.col("td_idx"), calendar.agg(F.count(F.lit(1))).scalar()), keep)


def build_target(panel: DataFrame, calendar: DataFrame, name: str, **overrides) -> DataFrame:
    """(date, sid, label) for one registered target; only the columns the recipe reads are scanned."""
    recipe = make_recipe(name, **overrides)
    return build_targets(panel, calendar, [recipe]).select("date", "sid", F.col(name).alias("label"))


def label_guards(
    targets: DataFrame, calendar: DataFrame, name: str, horizon: int, min_listed_days: int | None = None
) -> DataFrame:
    """Add the documented guards to a target. `targets` carries td_idx, list_date and delist_date.

    Order: value missing, instrument too young, delisted inside the window, window past the calendar.
    The most structural reason wins.
    """
    exit_days = calendar.select((F.col("td_idx") - F.lit(horizon)).alias("td_idx"), F.col("date").alias("_exit_date"))
    label = F.col(name)
    young = F.lit(False) if min_listed_days is None else F.datediff("date", "list_date") < min_listed_days
    reason = (
        F.when(F.col("_exit_date").isNull(), "INSUFFICIENT_FORWARD_WINDOW")
        .when(F.coalesce(F.col("_exit_date") > F.col("delist_date"), F.lit(False)), "DELISTED_IN_WINDOW")
        .when(young, "STOCK_TOO_YOUNG")
        .when(is_missing(label["value"]), "LABEL_IS_NAN")
        .otherwise("")
    )
    return targets.join(F.broadcast(exit_days), "td_idx", "left").select(
        "date", "sid", _label(label["value"], reason == "", reason).alias("label")
    )


def train_mask(usable: Column, labels: Iterable[Column], suspended: Column | None = None) -> Column:
    """Usable row with every label valid, optionally without suspended rows."""
    mask = usable
    for label in labels:
        mask = mask & label["valid"]
    return mask & ~suspended if suspended is not None else mask


def label_panel(panel: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """The panel with one label struct per target, joined by key."""
    clashes = [n for n in targets if n in panel.columns]
    if clashes:
        raise SchemaError(f"panel already has columns {clashes}")
    for name, block in targets.items():
        panel = panel.join(block.select("date", "sid", F.col("label").alias(name)), ["date", "sid"], "left")
    return panel
