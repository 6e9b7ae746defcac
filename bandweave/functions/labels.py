"""Category text, soft labels, tiers and vocabularies as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import LABELS_RAW, REVIEW_WEIGHTS

# ---- fixed values: must equal the reference's for right results ----
TIER_WEIGHTS = {"high": 1.0, "moderate": 0.5, "low": 0.25}
TIER_PATTERN = r"\((\w+)\)"
TOKENS = {
    "type 1 olivine": {"olivine_t1": 1.0},
    "type 2 olivine": {"olivine_t2": 1.0},
    "olivine": {"olivine_t1": 0.5, "olivine_t2": 0.5},
    "lcp": {"lcp": 1.0},
    "hcp": {"hcp": 1.0},
    "plagioclase": {"plagioclase": 1.0},
    "other": {"other": 1.0},
    "alteration": {"alteration": 1.0},
    "red slope": {},
    "spinel": {},
    "pyroxene": {},
}
WEIGHT_SCHEMES = {
    "level": {"high": 1.0, "moderate": 0.85, "low": 0.70, "reviewed-legacy": 1.0},
    "review_up": {"high": 1.0, "moderate": 0.85, "low": 0.70, "reviewed-high": 2.0,
                  "reviewed-moderate": 1.7, "reviewed-low": 1.4, "reviewed-legacy": 1.5},
    "hand_up": {"high": 1.5, "moderate": 1.3, "low": 1.0, "reviewed-high": 1.0,
                "reviewed-moderate": 0.85, "reviewed-low": 0.70, "reviewed-legacy": 0.85},
}
RELABEL_TIERS = {"high": 1.0, "moderate": 0.6, "low": 0.3}
ID_MINERALS = ["olivine", "plagioclase", "lcp", "hcp", "red slope", "felsic", "alteration", "spinel"]
BLAND_ALIASES = ["bland", "dust", "dusty", "other"]
GRADED_SESSION = r"_7cls_v\d+"
MC13_TILES = (1028, 1396)
# ---- end of fixed values ----


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Small constant table as a CASE, kept inside generated code."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


# ---------------------------------------------------------------- categories

def tier_text(category) -> Column:
    """Text in the first parentheses with its case kept; 'Low' when there is none."""
    found = F.regexp_extract(_col(category), TIER_PATTERN, 1)
    return F.when(found == "", "Low").otherwise(found)


def tier_weight(category) -> Column:
    return lookup(F.lower(tier_text(category)), TIER_WEIGHTS, 0.25)


def category_tokens(category) -> Column:
    minerals = F.trim(F.regexp_replace(_col(category), TIER_PATTERN, ""))
    return F.transform(F.split(minerals, r"\+"), lambda t: F.lower(F.trim(t)))


def token_key(token: Column) -> Column:
    """Longest known key contained in the token."""
    out = F.lit(None).cast("string")
    for key in sorted(TOKENS, key=len):
        out = F.when(token.contains(key), F.lit(key)).otherwise(out)
    return out


def soft_labels(category) -> dict[str, Column]:
    """Seven soft labels; each token uses its longest key, repeated labels keep the maximum."""
    keys = F.transform(category_tokens(category), token_key)
    out = {}
    for label in LABELS_RAW:
        value = F.lit(0.0)
        for key, gives in sorted(TOKENS.items(), key=lambda kv: kv[1].get(label, 0.0)):
            if gives.get(label):
                value = F.when(F.array_contains(keys, key), gives[label]).otherwise(value)
        out[label] = value
    return out


def with_category(df: DataFrame, category: str = "Category") -> DataFrame:
    """Soft labels, weight and tier of a category column; blank categories are dropped."""
    kept = df.where(F.col(category).isNotNull() & (F.trim(category) != ""))
    return kept.withColumns({**soft_labels(category), "confidence_weight": tier_weight(category),
                             "confidence_tier": tier_text(category)})


def unknown_token(category) -> Column:
    """True when the category is blank or a non-blank token holds no known key."""
    c = _col(category)
    tokens = F.filter(category_tokens(c), lambda t: t != "")
    return c.isNull() | (c == "") | F.exists(tokens, lambda t: token_key(t).isNull())


def assert_categories(df: DataFrame, category: str = "Category") -> DataFrame:
    """Fail the job on the first category the parser does not know."""
    ok = F.assert_true(~unknown_token(category), F.concat(F.lit("unparseable category: "), F.coalesce(category, F.lit(""))))
    return df.where(ok.isNull())


# fixed values: keywords and tile groups of the polygon evaluation
EVAL_KEYWORDS = [("olivine", ["olivine"]), ("lcp", ["lcp"]), ("hcp", ["hcp"]),
                 ("plagioclase", ["plagioclase", "plagiolcase"]), ("spinel", ["spinel"]),
                 ("alteration", ["alteration", "alter"])]
REGION_TILES = {
    "argyre": ["t0431", "t0432", "t0433", "t0434", "t0435", "t0436", "t0437",
               "t0505", "t0506", "t0507", "t0540", "t0541", "t0542"],
    "nili": ["t1249", "t1250", "t1321", "t1322"],
    "hellas": ["t0183", "t0184", "t0185", "t0235", "t0236", "t0237", "t0238", "t0239", "t0240"],
}
REGION_DEFAULT = "cmu"
NAMED_TIER = r"(?i)\((high|moderate|low)\)"
NOT_PURE = ["other", "alteration", "spinel"]


def keyword_minerals(category, keywords=EVAL_KEYWORDS, fallback: str = "other") -> Column:
    """Minerals named in the text; the fallback only when none is named."""
    text = F.lower(_col(category))
    named = F.array_compact(F.array(*[F.when(any_of([text.contains(w) for w in words]), F.lit(name))
                                      for name, words in keywords]))
    return F.when((F.size(named) == 0) & text.contains(fallback), F.array(F.lit(fallback))).otherwise(named)


def named_tier(category) -> Column:
    """High / Moderate / Low in parentheses, capitalised; '' when absent."""
    return F.initcap(F.regexp_extract(_col(category), NAMED_TIER, 1))


def stamped_tier(category, default: str = "Moderate") -> Column:
    """Tier written exactly as '(High)', '(Moderate)' or '(Low)', else the default."""
    text = _col(category)
    out = F.lit(default)
    for tier in ("Low", "Moderate", "High"):
        out = F.when(text.contains(f"({tier})"), tier).otherwise(out)
    return out


def is_pure_mineral(minerals) -> Column:
    m = _col(minerals)
    return (F.size(m) == 1) & ~F.get(m, F.lit(0)).isin(*NOT_PURE)


def is_pure(minerals, vocabulary: list[str]) -> Column:
    """Exactly one of the named minerals is in the vocabulary."""
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    return F.size(F.filter(_col(minerals), lambda m: F.array_contains(vocab, m))) == 1


def label_indices(minerals, vocabulary: list[str]) -> Column:
    """Sorted 0-based vocabulary positions of the named minerals."""
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    known = F.array_distinct(F.filter(_col(minerals), lambda m: F.array_contains(vocab, m)))
    return F.array_sort(F.transform(known, lambda m: F.array_position(vocab, m).cast("int") - 1))


def primary_mineral(minerals, classes: list[str]) -> Column:
    """First named mineral that is one of the core classes, else NULL."""
    vocab = F.array(*[F.lit(v) for v in classes])
    return F.get(F.filter(_col(minerals), lambda m: F.array_contains(vocab, m)), F.lit(0))


def is_olivine_only(category) -> Column:
    text = F.lower(F.coalesce(_col(category), F.lit("")))
    return text.contains("olivine") & ~any_of([text.contains(w) for w in ("lcp", "hcp", "pyrox", "plag")])


def mineral_category(ids: list[str]) -> Column:
    """Category text from the four mineral-id columns and their doubt marks."""
    low, moderate, names = F.lit(False), F.lit(False), []
    for position, name in enumerate(ids):
        text = F.lower(F.coalesce(F.col(name), F.lit("")))
        doubt = text.contains("±") | text.contains("uncertain")
        weak = text.contains("felsic") | text.contains("slope")
        if position == 0:
            low = low | doubt | weak
        else:
            low = low | weak | text.contains("alteration")
            moderate = moderate | doubt
        bare = F.when(text.contains("±"), F.trim(F.regexp_replace(text, "±", ""))).otherwise(text)
        names.append(F.when(bare.isin(*ID_MINERALS), bare))
    tier = F.when(low, "Low").when(moderate, "Moderate").otherwise("High")
    found = F.array_sort(F.array_compact(F.array(*names)))
    base = F.when(F.size(found) == 0, F.lit("Other")).otherwise(F.array_join(found, " + "))
    return F.concat(base, F.lit(" ("), tier, F.lit(")"))


def contaminated_denominator(ids: list[str]) -> Column:
    """First id is exactly 'denom' while another id holds text."""
    first = F.lower(F.trim(F.coalesce(F.col(ids[0]), F.lit(""))))
    return (first == "denom") & any_of([F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ids[1:]])


def default_tier_category(column) -> Column:
    """Category synthesised from another column with the default tier."""
    return F.concat(_col(column), F.lit(" (Moderate)"))


def relabel_targets(new_label) -> dict[str, Column]:
    """Soft pyroxene targets of a relabel text; NULL where the text names none."""
    text = F.lower(_col(new_label))
    tier = F.regexp_extract(text, r"\((high|moderate|low)\)", 1)
    value = lookup(tier, RELABEL_TIERS, 1.0)
    return {c: F.when(text.contains(c), value) for c in ("hcp", "lcp")}


# --------------------------------------------------------------- weights etc.

def scheme_weight(tier, stamped=None, scheme: str = "level") -> Column:
    """Tier weight of a named scheme, else the stamped weight, else Moderate."""
    if scheme not in WEIGHT_SCHEMES:
        raise ValueError(f"unknown weight scheme {scheme!r}")
    table = WEIGHT_SCHEMES[scheme]
    mapped = lookup(F.lower(_col(tier)), table, None).cast("double")
    if stamped is not None:
        mapped = F.coalesce(mapped, _col(stamped).cast("double"))
    return F.coalesce(mapped, F.lit(table["moderate"]))


def collapse_labels(df: DataFrame, scheme: str = "level") -> DataFrame:
    """Merge olivine types and pyroxenes, harden the flags, resolve the weight."""
    have = set(df.columns)

    def flag(name: str, default: Column = F.lit(0.0)) -> Column:
        return F.when(F.col(name) > 0, 1.0).otherwise(0.0) if name in have else default

    lcp = F.col("lcp") if "lcp" in have else F.lit(0.0)
    hcp = F.col("hcp") if "hcp" in have else F.lit(0.0)
    new = {
        "olivine": F.when(F.greatest("olivine_t1", "olivine_t2") > 0, 1.0).otherwise(0.0),
        "alteration": flag("alteration"),
        "bland": flag("bland", flag("other")),
        "junk": flag("junk"),
        "lcp": lcp,
        "hcp": hcp,
        "pyx": F.greatest(lcp, hcp),
    }
    if "confidence_tier" in have:
        new["confidence_weight"] = scheme_weight("confidence_tier", "confidence_weight" if "confidence_weight" in have else None, scheme)
    elif "confidence_weight" not in have:
        new["confidence_weight"] = F.lit(WEIGHT_SCHEMES[scheme]["moderate"])
    return df.withColumns(new)


def confidence_defaults(df: DataFrame) -> DataFrame:
    weight = F.col("confidence_weight") if "confidence_weight" in df.columns else F.lit(None)
    tier = F.col("confidence_tier") if "confidence_tier" in df.columns else F.lit(None)
    return df.withColumns({"confidence_weight": F.coalesce(weight.cast("double"), F.lit(1.0)),
                           "confidence_tier": F.coalesce(tier.cast("string"), F.lit("High"))})


def any_mineral(columns, above: float = 0.5) -> Column:
    return any_of([F.col(c) > above for c in columns])


def multi_hot(classes, labels=LABELS_RAW) -> dict[str, Column]:
    """Label columns of a class list; olivine means type 1, the bland names mean 'other'."""
    c = _col(classes)
    alias = {"olivine_t1": ["olivine", "olivine_t1"], "other": BLAND_ALIASES}
    return {label: F.when(F.arrays_overlap(c, F.array(*[F.lit(a) for a in alias.get(label, [label])])), 1.0).otherwise(0.0)
            for label in labels}


def is_mineral_class(label) -> Column:
    return _col(label).isin("olivine", "lcp", "hcp", "plagioclase", *BLAND_ALIASES)


def review_weight(confidence) -> Column:
    return lookup(_col(confidence), REVIEW_WEIGHTS, None).cast("double")


def session_of(path) -> Column:
    """Graded review session or the ungraded legacy one, read from the folder name."""
    return F.when(_col(path).rlike(GRADED_SESSION), "v3").otherwise("legacy")


def in_mc13(tile) -> Column:
    number = F.regexp_replace(_col(tile), "^t+", "").try_cast("int")
    return F.coalesce(number.between(*MC13_TILES), F.lit(False))


def tile_region(tile, regions: dict[str, list[str]] = REGION_TILES, default: str = REGION_DEFAULT) -> Column:
    text, out = F.lower(_col(tile)), F.lit(default)
    for name, members in reversed(list(regions.items())):
        out = F.when(text.isin(*members), name).otherwise(out)
    return out


# ------------------------------------------------------------ score vectors

def best_class(probs, thresholds: list[float], valid=None) -> Column:
    """Best class among those at or above their own threshold; C when none, -1 when invalid."""
    p = _col(probs)
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    kept = F.zip_with(p, limits, lambda x, t: F.when(x >= t, x.cast("double")))
    top = F.array_max(kept)
    code = F.when(top.isNull(), F.lit(len(thresholds))).otherwise(F.array_position(kept, top).cast("int") - 1)
    return code if valid is None else F.when(_col(valid), code).otherwise(F.lit(-1))


def inverse_ap_threshold(ap, floor: float = 0.5) -> Column:
    return F.greatest(F.lit(0.99) - F.lit(0.49) * _col(ap), F.lit(floor))


def class_bits(flags: list[Column]) -> Column:
    """Bit i is set where flag i holds."""
    return reduce(lambda a, b: a + b, [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags)])


def bits_text(bits, names: list[str], empty: str = "unclassified") -> Column:
    b = _col(bits)
    parts = [F.when(b.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]
    return F.when(b == 0, F.lit(empty)).otherwise(F.concat_ws(" + ", *parts))


def bland_gate(valid, probs, channels: list[str], gate: float, name: str = "bland") -> Column:
    """Valid pixels whose bland score is below the gate."""
    if name not in channels:
        raise ValueError(f"no {name} channel in {channels}")
    return _col(valid) & (_col(probs)[channels.index(name)] < gate)


# fixed values: score strata, half-open, the last one closed
STRATA = [(0.5, 0.85), (0.85, 0.97), (0.97, 0.99), (0.99, 0.999), (0.999, 0.9999), (0.9999, 1.0)]


def stratum(score) -> Column:
    p = _col(score).cast("double")
    out = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(STRATA))):
        inside = (p >= low) & ((p <= high) if i == len(STRATA) - 1 else (p < high))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return F.when(p.isNull() | F.isnan(p), F.lit(None)).otherwise(out)


def collapsed_truth(labels) -> Column:
    """Six raw labels (t1, t2, lcp, hcp, plagioclase, other) -> five classes."""
    v = _col(labels)
    return F.array(v[0] + v[1], v[2], v[3], v[4], v[5])


def truth_argmax(labels) -> Column:
    c = collapsed_truth(labels)
    return F.array_position(c, F.array_max(c)).cast("int") - 1


def truth_positives(labels) -> Column:
    return F.array_compact(F.transform(collapsed_truth(labels), lambda x, i: F.when(x > 0, i)))


def truth_text(labels, names: list[str]) -> Column:
    c = collapsed_truth(labels)
    parts = [F.when(c[i] > 0, F.format_string(f"{n}(%.2f)", c[i])) for i, n in enumerate(names)]
    text = F.concat_ws(" + ", *parts)
    return F.when(text == "", "(none)").otherwise(text)


def read_number(token: Column) -> Column:
    """``try_cast`` to double; what cannot begin a number, and 'nan', is told by pattern, since a failed cast is costly."""
    number = F.when(token.rlike(r"^[\x00-\x20]*[+-]?(?i:nan|inf|[0-9.])"), token.try_cast("double"))
    return F.when(F.lower(token) == "nan", F.lit(float("nan"))).otherwise(number)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def parse_numbers(text, min_len: int = 6) -> Column:
    """Numbers in a text blob; fewer than ``min_len`` readable values give NULL."""
    cleaned = F.trim(F.regexp_replace(_col(text), r"[\[\],\s]+", " "))
    values = F.filter(F.transform(F.split(cleaned, " "), read_number), lambda x: x.isNotNull())
    return bound(values, lambda v: F.when(F.size(v) >= min_len, v))


def parse_slots(text) -> Column:
    """Comma-separated numbers with 'nan' kept as an empty slot; other junk is skipped."""
    inner = F.regexp_replace(_col(text), r"[\[\]\s]", "")
    numbers = F.filter(F.transform(F.split(inner, ","), read_number), lambda x: x.isNotNull())
    return F.transform(numbers, lambda x: F.when(~F.isnan(x), x))
