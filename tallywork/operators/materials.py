"""Naming things: which material a text means, how a product line is classified, likely names for an unknown one."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import accounting_number
from ..functions.text import is_blank, strip

# Equivalent words, supplies that are no material, packaging words, review labels.
EQUIVALENT = {
    "CASE": "PACK", "CASES": "PACK", "PACK": "PACK", "PACKS": "PACK", "PK": "PACK", "PKS": "PACK", "ROLL": "FILM",
    "ROLLS": "FILM", "FILM": "FILM", "FILMS": "FILM",
}
NON_INVENTORY = (
    "PALLETWRAP", "SLIPSHEET", "PAPER", "PARTS", "SUPPLIES", "FLUTE", "STRAPPING", "STRETCHWRAP", "TOWEL", "GLOVES",
    "CLEANER", "CHEMICAL", "ACID", "SQUEEGEE", "BROOM", "MOTOR", "HARDWARE", "ANTIFATIGUE", "SMOKEURN",
)
PACKAGING = ("CASE", "CASES", "CS", "CSE", "PACK", "PACKS", "PK", "PKS", "PCK", "PKG", "COUNT", "CT")
PACK_SIZES = (24, 32, 40)
SIZE_UNCLEAR, NEW_32, UNRECOGNIZED = "Needs review – size unclear", "New item – 32-count", "Unrecognized product"
REVIEW_LABELS = (SIZE_UNCLEAR, NEW_32, UNRECOGNIZED)
CLOSE = 0.82
QTY_TOLERANCE = 0.0001
# A lexicon or product list is a dimension people maintain; anything larger is not one and must be joined instead.
MAX_DIMENSION = 20_000


def name_key(value) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def match_key(value) -> Column:
    """Letters and digits with words and numbers apart, equivalent words made one, repeats of a word dropped."""
    words = F.regexp_extract_all(F.upper(value), F.lit(r"([A-Z]+|\d+)"), 1)
    table = F.create_map(*[F.lit(x) for item in EQUIVALENT.items() for x in item])
    same = F.transform(words, lambda w: F.coalesce(table[w], w))
    kept = F.filter(
        F.transform(same, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get(same, i - 1)).alias("before"))),
        lambda p: p["before"].isNull() | (p["before"] != p["w"]) | p["w"].rlike("^[0-9]"),
    )
    return F.concat_ws("", F.transform(kept, lambda p: p["w"]))


def is_non_inventory(value) -> Column:
    return name_key(value).rlike("|".join(NON_INVENTORY))


def spelling_table(products: DataFrame, known: DataFrame | None = None, saved: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(rank, key, alias, aliases): every spelling of every product by priority; `aliases` > 1 is ambiguous.

    `products`: alias, name. `known` and `saved`: spelling, alias. `ids`: product_id, alias.
    """
    parts = [products.select(F.lit(0).alias("rank"), F.concat(F.lit("alias:"), F.col("alias").cast("string")).alias("key"), "alias")]
    if saved is not None:
        parts.append(saved.select(F.lit(1).alias("rank"), match_key("spelling").alias("key"), "alias"))
    if ids is not None:
        parts.append(ids.select(F.lit(2).alias("rank"), F.concat(F.lit("id:"), F.col("product_id")).alias("key"), "alias"))
    if known is not None:
        parts.append(known.select(F.lit(3).alias("rank"), match_key("spelling").alias("key"), "alias"))
    code, rest = F.regexp_extract("name", r"^(.*?) - ", 1), F.regexp_extract("name", r"^.*? - (.*)$", 1)
    spellings = F.explode(F.filter(F.array(F.col("name"), code, rest), lambda s: s != ""))
    parts.append(products.select(F.lit(4).alias("rank"), spellings.alias("s"), "alias").select("rank", match_key("s").alias("key"), "alias"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    live = out.join(products.select("alias"), "alias", "left_semi").filter("key <> ''")
    return live.groupBy("rank", "key").agg(F.min("alias").alias("alias"), F.count_distinct("alias").alias("aliases"))


def resolve_cells(rows: DataFrame, cells: list[str], spellings: DataFrame, row_id: str) -> DataFrame:
    """(row_id, alias, status): OK, UNMAPPED or AMBIGUOUS from the identifying cells of each row.

    Each cell takes its best-ranked spelling. Cells that name different materials are a conflict, never a pick.
    """
    cell = rows.select(row_id, F.explode(F.array(*[F.col(c).cast("string") for c in cells])).alias("text")).filter(~is_blank("text"))
    text = strip("text")
    key = match_key("text")
    product_id = F.regexp_extract(F.upper(text), r"^ITM[\s_-]?0*(\d+)$", 1)
    keys = F.array_compact(F.array(
        F.when(text.rlike(r"^\d{1,3}(\.0+)?$"), F.struct(F.lit(0).alias("rank"), F.concat(F.lit("alias:"), text.try_cast("double").cast("int").cast("string")).alias("key"))),
        *[F.struct(F.lit(r).alias("rank"), key.alias("key")) for r in (1, 3, 4)],
        F.when(product_id != "", F.struct(F.lit(2).alias("rank"), F.concat(F.lit("id:ITM-"), F.lpad(product_id, F.greatest(F.lit(2), F.length(product_id)), F.lit("0"))).alias("key"))),
    ))
    tried = cell.select(row_id, "text", F.explode(keys).alias("k")).select(row_id, "text", "k.rank", "k.key")
    best = tried.join(spellings, ["rank", "key"], "left").groupBy(row_id, "text").agg(
        F.min(F.when(F.col("alias").isNotNull(), F.struct("rank", "alias", "aliases"))).alias("hit")
    )
    ok = F.col("hit.aliases") == 1
    per_row = best.groupBy(row_id).agg(
        F.count_distinct(F.when(ok, F.col("hit.alias"))).alias("named"), F.min(F.when(ok, F.col("hit.alias"))).alias("alias"),
        F.max(F.coalesce(F.col("hit.aliases") > 1, F.lit(False))).alias("unclear"),
    )
    status = F.when(F.col("named") > 1, "AMBIGUOUS").when(F.col("named") == 1, "OK").when(F.col("unclear"), "AMBIGUOUS").otherwise("UNMAPPED")
    found = per_row.select(row_id, F.when(F.col("named") == 1, F.col("alias")).alias("alias"), status.alias("status"))
    return rows.select(row_id).join(found, row_id, "left").withColumn("status", F.coalesce("status", F.lit("UNMAPPED")))


def ending_counts(rows: DataFrame, resolved: DataFrame, row_id: str, name: str, qty: str) -> DataFrame:
    """One outcome per count line: used, blank, invalid, ignored, unmapped, heading, or duplicate.

    Different spellings of one material are counted together; the same line twice makes the count ambiguous.
    """
    number = accounting_number(qty)
    line = rows.join(resolved, row_id).withColumns({"value": number, "blank": is_blank(qty)})
    usable = (F.col("status") == "OK") & F.col("value").isNotNull() & (F.col("value") >= -QTY_TOLERANCE)
    line = line.withColumn("usable", usable)
    per = line.filter("usable").groupBy("alias").agg(
        F.count("*").alias("lines"), F.count_distinct(name_key(name)).alias("names"), F.sum("value").alias("counted")
    )
    out = line.join(per, "alias", "left")
    outcome = (
        F.when(F.col("status") != "OK", F.when(F.col("blank"), "heading").when((F.col("status") == "UNMAPPED") & is_non_inventory(name), "ignored").otherwise("unmapped"))
        .when(F.col("blank"), "blank").when(~F.col("usable"), "invalid")
        .when((F.col("lines") > 1) & (F.col("names") < F.col("lines")), "duplicate").otherwise("used")
    )
    return out.withColumn("outcome", outcome).withColumn("counted", F.when(F.col("outcome") == "used", F.col("counted"))).drop("usable", "blank", "lines", "names")


# --- names by likeness ------------------------------------------------------------------------------------------

def _dimension(df: DataFrame) -> list:
    rows = df.limit(MAX_DIMENSION + 1).collect()
    if len(rows) > MAX_DIMENSION:
        raise ValueError(f"A lexicon of more than {MAX_DIMENSION} entries is not a dimension.")
    return rows


def suggest_names(unknown: DataFrame, column: str, products: DataFrame, most: int = 3, least: float = 0.5) -> DataFrame:
    """(name, suggestions): the likeliest products for each distinct unknown name. For display only."""
    known = [(r["alias"], r["name"], re.sub("[^A-Z0-9]", "", r["name"].upper())) for r in _dimension(products.select("alias", "name"))]

    @F.pandas_udf("array<string>")
    def likely(names: pd.Series) -> pd.Series:
        def one(key: str) -> list[str]:
            scored = sorted(((difflib.SequenceMatcher(None, key, k).ratio(), a, n) for a, n, k in known), reverse=True)
            return [f"{a} {n}" for ratio, a, n in scored[:most] if ratio >= least]

        return names.map(one)

    return unknown.select(F.col(column).alias("name")).distinct().withColumn("suggestions", likely(name_key("name")))


def strip_packaging(value) -> Column:
    apart = F.regexp_replace(value, r"(?<=\d)(?=[A-Z])|(?<=[A-Z])(?=\d)", " ")
    return F.regexp_replace(apart, r"\b(?:" + "|".join(PACKAGING) + r")\b", " ")


def _clean(value) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"^([0-9]+)\.0+$", "$1"), "[^A-Z0-9]", "")


def pack_size(name) -> Column:
    size = F.regexp_extract(name, r"(?i)\s+(\d+)\s+CASE$", 1).try_cast("int")
    return F.when(size.isin(*PACK_SIZES), size)


def classify_products(lines: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """(text, label): a product name or a review label per distinct description. Reporting only, never a match.

    `lexicon`: standard_name, spelling, place (later places win a shared spelling). Exact names are a join; only the
    descriptions it leaves go through the likeness function, each distinct text once.
    """
    names = lexicon.select("standard_name", F.upper("spelling").alias("s"), "place").unionByName(
        lexicon.select("standard_name", F.upper("standard_name").alias("s"), "place")
    )
    keyed = names.select("standard_name", "place", F.explode(F.array(_clean(F.col("s")), _clean(strip_packaging(F.col("s"))))).alias("key"))
    table = keyed.filter("key <> ''").groupBy("key").agg(F.max_by("standard_name", "place").alias("product"))
    texts = lines.select(F.upper(strip(F.coalesce(column, F.lit("")))).alias("text")).distinct()
    keys = texts.select("text", _clean(strip_packaging(F.col("text"))).alias("k1"), _clean(F.col("text")).alias("k2"))
    t1, t2 = table.select(F.col("key").alias("k1"), F.col("product").alias("p1")), table.select(F.col("key").alias("k2"), F.col("product").alias("p2"))
    exact = keys.join(t1, "k1", "left").join(t2, "k2", "left").withColumn("product", F.coalesce("p1", "p2"))
    known = {r["key"]: r["product"] for r in _dimension(table)}
    hosts = set(PACKAGING) | {w for r in _dimension(names.select("s").distinct()) for w in re.findall("[A-Z]+", r["s"])}
    glued = re.compile(r"\b([A-Z]+?)(?:CASES?|PACKS?|COUNT)\b")
    order = list(known)

    @F.pandas_udf("string")
    def closest(text: pd.Series, stripped: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.Series:
        def near(key: str):
            hit = difflib.get_close_matches(key, order, n=1, cutoff=CLOSE)
            return known[hit[0]] if hit else None

        def one(bare: str, first: str, second: str):
            found = near(first) or near(second)
            if found is None:
                loose = re.sub("[^A-Z0-9]", "", glued.sub(lambda m: m.group(1) if m.group(1) in hosts else m.group(0), bare))
                if loose and loose != first:
                    found = known.get(loose) or near(loose)
            return found

        return pd.Series([one(*x) for x in zip(stripped, k1, k2)])

    residue = exact.filter("product IS NULL AND k1 <> ''").withColumn(
        "product", closest("text", strip_packaging(F.col("text")), "k1", "k2")
    )
    every = exact.filter("product IS NOT NULL OR k1 = ''").select("text", "k1", "product").unionByName(residue.select("text", "k1", "product"))
    brands = lexicon.select("standard_name").distinct().select(
        F.regexp_replace("standard_name", r"(?i)\s+\d+\s+CASE$", "").alias("brand"), pack_size(F.col("standard_name")).alias("size")
    ).groupBy("brand").agg(F.count_distinct("size").alias("brand_sizes"))
    sized = every.withColumns({
        "brand": F.regexp_replace("product", r"(?i)\s+\d+\s+CASE$", ""), "size": pack_size(F.col("product")),
        "sizes": F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(\d+)"), 1), lambda x: x.try_cast("bigint"))),
    }).join(F.broadcast(brands), "brand", "left")
    size = F.coalesce(F.col("size").cast("bigint"), F.lit(-1))
    label = (
        F.when(F.col("k1") == "", UNRECOGNIZED)
        .when(F.array_contains("sizes", F.lit(32).cast("bigint")) & (size != 32), NEW_32)
        .when(F.col("product").isNull(), UNRECOGNIZED)
        .when(F.size("sizes") > 0, F.when((F.size("sizes") == 1) & (F.get("sizes", F.lit(0)) == size), F.col("product")).otherwise(SIZE_UNCLEAR))
        .when(F.col("brand_sizes") == 1, F.col("product")).otherwise(SIZE_UNCLEAR)
    )
    return sized.select("text", label.alias("label"))
