"""Column-to-column functions; every one stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuelens import lexicons as L

Cols = Column | str


def _c(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: Cols) -> Column:
    c = _c(x)
    return F.when(~F.isnan(c), c)


# ---- prices and encodings --------------------------------------------------------------

def clean_price(text: Cols) -> Column:
    """Price text to double; NULL when what is left is not one decimal number."""
    bare = F.trim(F.translate(_c(text), "€\u00a0 ", ""), F.lit("\t\n\r\x0b\x0c"))
    numeric = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return with_value(F.replace(bare, F.lit(","), F.lit(".")),
                      lambda t: F.when(t.rlike(numeric), t.try_cast("double")))


def price_level(symbols: Cols) -> Column:
    """Number of euro signs; a range counts the signs of both ends."""
    c = _c(symbols)
    return (F.length(c) - F.length(F.replace(c, F.lit("€"), F.lit("")))).cast("int")


def split_labels(joined: Cols, trim: bool = True) -> Column:
    """``a|b`` to an array of non-empty labels; NULL gives an empty array."""
    parts = F.split(F.coalesce(_c(joined), F.lit("")), "[|]")
    if not trim:
        return parts
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def join_labels(labels: Cols) -> Column:
    return F.nullif(F.array_join(_c(labels), "|"), F.lit(""))


def district_number(neighborhoods: Cols) -> Column:
    # Fixed value: the pattern of a district number.
    pattern = r"(\d{1,2})\s*(?:er|e|ème|eme)\s*Arr"
    return F.nullif(F.regexp_extract(_c(neighborhoods), pattern, 1), F.lit("")).try_cast("int")


def district_label(n: Cols) -> Column:
    return F.coalesce(F.concat(F.lit(L.DISTRICT_PREFIX), _c(n).cast("int").cast("string")), F.lit(L.DISTRICT_UNKNOWN))


def short_name(name: Cols, width: int) -> Column:
    return F.substring(_c(name), 1, width)


# ---- text ------------------------------------------------------------------------------

def item_text(title: Cols, description: Cols) -> Column:
    return F.lower(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "),
                            F.coalesce(_c(description), F.lit(""))))


def with_value(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` loops over it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Substring test against a list; a loop over a constant array, which measured faster than one
    alternation pattern and than a chain of tests too long for the JIT compiler."""
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def first_class(text: Column, ordered_terms: list[tuple[str, list[str]]]) -> Column:
    """Label of the first class that has a term in the text, else NULL."""
    return with_value(text, lambda t: F.coalesce(
        *[F.when(contains_any(t, terms), F.lit(label)) for label, terms in ordered_terms]))


def menu_category(title: Cols) -> Column:
    return first_class(F.lower(_c(title)), L.MENU_TITLE_TERMS)


def item_category(title: Cols, description: Cols, menu_cat: Cols, price: Cols,
                  n_prices: Cols, q_low: Cols, q_high: Cols) -> Column:
    """Category of one item: inherited, by terms, by price position in its venue, or other."""
    text = F.trim(item_text(title, description))
    by_terms = first_class(text, L.ITEM_TERMS)
    by_price = F.when(
        _c(price).isNotNull() & (_c(n_prices) >= 3),
        F.when(_c(price) <= _c(q_low), F.lit(L.STARTER))
         .when(_c(price) >= _c(q_high), F.lit(L.MAIN)))
    inherited = F.nullif(_c(menu_cat), F.lit(L.SET_MENU))
    return F.coalesce(inherited, F.when(text == "", F.lit(L.OTHER)), by_terms, by_price, F.lit(L.OTHER))


def tokens(text: Cols, min_chars: int = 3) -> Column:
    """Unicode word tokens of the lower-cased text with at least ``min_chars`` characters."""
    pattern = F.lit(rf"(?U)(\w{{{min_chars},}})")
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), pattern, 1)


def count_words(text: Cols, words: list[str]) -> Column:
    """How many word tokens of the text are in the list."""
    pattern = F.lit(rf"(?U)\b(?:{'|'.join(words)})\b")
    return F.regexp_count(F.lower(F.coalesce(_c(text), F.lit(""))), pattern)


def terms_in(text: Column, groups: dict[str, list[str]], group: str = "season") -> Column:
    """The ``(group, term)`` pairs of fixed lists whose term occurs in the text as a substring."""
    listed = F.array(*[F.struct(F.lit(g).alias(group), F.lit(t).alias("term")) for g, terms in groups.items() for t in terms])
    return with_value(text, lambda t: F.filter(listed, lambda p: F.contains(t, p["term"])))


# ---- sentiment -------------------------------------------------------------------------

PROB_COLUMNS = ["p_1star", "p_2star", "p_3star", "p_4star", "p_5star"]


def expected_stars(probs: list[str] = PROB_COLUMNS) -> Column:
    return reduce(lambda a, b: a + b, [F.col(p) * (i + 1) for i, p in enumerate(probs)])


def top_class(probs: list[str] = PROB_COLUMNS) -> Column:
    arr = F.array(*probs)
    return F.array_position(arr, F.array_max(arr)).cast("int")


def confidence(probs: list[str] = PROB_COLUMNS) -> Column:
    return F.greatest(*[F.col(p) for p in probs])


def is_ironic(cls: Cols = "sent_class", rating: Cols = "rating") -> Column:
    """Text reads positive (class >= 4) while the rating is at most 2; NULL rating is not ironic."""
    return F.coalesce((_c(cls) >= 4) & (_c(rating) <= 2), F.lit(False))


def corrected(flag: Cols, rating: Cols, predicted: Cols) -> Column:
    return F.when(_c(flag), _c(rating)).otherwise(_c(predicted))


def share_pct(condition: Column, null_is_false: bool = False) -> Column:
    """Percentage of rows where the condition holds; as an aggregate."""
    c = F.coalesce(condition, F.lit(False)) if null_is_false else condition
    return F.avg(c.cast("double")) * 100


# ---- binning and labels ----------------------------------------------------------------

def right_closed_bin(x: Cols, bins: list[tuple[float, str]] = L.QUALITY_BINS, low: float = 0.0) -> Column:
    """Label of the interval ``(previous, upper]`` that holds x, else NULL."""
    c = _c(x)
    expr = F.when(c <= low, F.lit(None).cast("string"))
    for upper, label in bins:
        expr = expr.when(c <= upper, F.lit(label))
    return expr


def month_name(month: Cols) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in L.MONTH_NAMES]), _c(month).cast("int"))


def star_label(cls: Cols) -> Column:
    return F.concat(_c(cls).cast("int").cast("string"), F.lit("★"))


def flag_label(flag: Cols, yes: str = "Michelin", no: str = "Non-Michelin") -> Column:
    return F.when(_c(flag), F.lit(yes)).when(~_c(flag), F.lit(no))


def ordinal_label(n: Cols) -> Column:
    return F.concat(_c(n).cast("int").cast("string"), F.lit("ᵉ"))


def banded(x: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """Label of the first band whose upper bound exceeds x."""
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for upper, label in bands:
        expr = expr.when(x < upper, F.lit(label))
    return expr.otherwise(F.lit(last))


def p_text(p: Column) -> Column:
    return (F.when(p < 0.001, F.lit("p < 0.001"))
             .when(p < 0.01, F.format_string("p = %.4f", p))
             .when(p.isNotNull(), F.format_string("p = %.3f", p)))


def p_verdict(p: Column) -> Column:
    # Significance thresholds and their labels.
    return banded(p, [(0.001, "Hautement significatif"), (0.01, "Tres significatif"),
                      (0.05, "Significatif")], "Non significatif")


# Effect-size bands of each test.
EFFECT_BANDS = {
    "chi2": ([(0.1, "tres faible"), (0.2, "faible"), (0.4, "moderee"), (0.6, "forte")], "tres forte"),
    "variance": ([(0.01, "tres faible"), (0.06, "faible"), (0.14, "moderee")], "forte"),
    "spearman": ([(0.1, "tres faible"), (0.3, "faible"), (0.5, "moderee"), (0.7, "forte")], "tres forte"),
    "welch": ([(0.2, "tres faible"), (0.5, "faible"), (0.8, "moderee"), (1.2, "forte")], "tres forte"),
}


def effect_label(test: str, x: Column) -> Column:
    return banded(x, *EFFECT_BANDS[test])
