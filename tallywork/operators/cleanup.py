"""Transaction clean-up, mapping lookups, vendor list comparison and master-data conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import beside, join_filled
from ..functions.identifiers import gl_account, name_key, vendor_key
from ..functions.text import is_blank, nonblank, strip

# The eleven positional source columns and the removal reasons.
SOURCE_COLUMNS = (
    "vendor", "invoice_date", "transaction_id", "description", "account", "cost_center", "amount", "tax_code",
    "reference", "code", "period",
)
REMOVAL_REASONS = {
    "letter": "Code begins with a letter",
    "excluded": "Excluded vendor ID",
    "duplicate": "Duplicate transaction ID",
}
MAPPING_COLUMNS = ("vendor_name", "vendor_id", "notes", "taxability", "grouping", "status")


def positional(df: DataFrame, position: str = "source_pos") -> DataFrame:
    """Name the eleven source columns by position; the position column rides along."""
    own = [c for c in df.columns if c != position]
    if len(own) != len(SOURCE_COLUMNS):
        raise ValueError(f"Source file has {len(own)} columns; exactly {len(SOURCE_COLUMNS)} are required.")
    return df.select(*[F.col(o).alias(n) for o, n in zip(own, SOURCE_COLUMNS)], F.col(position).alias("source_pos"))


def last_filled(df: DataFrame, key: Column, values: list[str], position: str) -> DataFrame:
    """One row per key: the last row in file order that has a value, else the last row. No window is needed."""
    blank = F.lit(True)
    for name in values:
        blank = blank & (vendor_key(name) == "")
    keyed = df.select(key.alias("key"), *values, F.struct((~blank).alias("filled"), F.col(position)).alias("rank"))
    best = keyed.filter("key <> ''").groupBy("key").agg(F.max_by(F.struct(*values), "rank").alias("v"))
    return best.select("key", *[F.coalesce(f"v.{n}", F.lit("")).alias(n) for n in values])


def membership(text_table: DataFrame, column: str, separators: str = r"[,;\s]+") -> DataFrame:
    """A list pasted as text, as a table of distinct keys."""
    return (
        text_table.select(F.explode(F.split(column, separators)).alias("raw")).select(vendor_key("raw").alias("key"))
        .filter("key <> ''").distinct()
    )


def mark_removals(source: DataFrame, excluded: DataFrame) -> DataFrame:
    """Adds keys, `drop_reason` (letter, excluded, duplicate, keep) and the kept row of each duplicate.

    Only rows that would otherwise stay compete for a transaction id; the first of them is kept.
    """
    keyed = source.withColumns(
        {
            "vendor_key": vendor_key("vendor"), "txn_key": vendor_key("transaction_id"),
            "letter": F.upper(F.substring(strip(F.coalesce("code", F.lit(""))), 1, 1)).rlike("[A-Z]"),
        }
    )
    keyed = join_filled(keyed, excluded.select(F.col("key").alias("vendor_key"), F.lit(True).alias("excluded")), ["vendor_key"], "source_pos").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    # Rows without an id, or not eligible, take no part in the duplicate test.
    firsts = keyed.filter("NOT letter AND NOT excluded AND txn_key <> ''").groupBy("txn_key").agg(
        F.min("source_pos").alias("first_pos"), F.count("*").alias("n")
    ).filter("n > 1").drop("n")
    joined = join_filled(keyed, firsts, ["txn_key"], "source_pos")
    duplicate = ~F.col("letter") & ~F.col("excluded") & (F.col("source_pos") > F.col("first_pos"))
    reason = (
        F.when(F.col("letter"), "letter").when(F.col("excluded"), "excluded").when(duplicate, "duplicate").otherwise("keep")
    )
    return joined.withColumn("drop_reason", reason).withColumn(
        "retained_pos", F.when(F.col("drop_reason") == "duplicate", F.col("first_pos"))
    ).drop("first_pos", "letter", "excluded")


def removed_rows(marked: DataFrame) -> DataFrame:
    reasons = F.create_map(*[F.lit(x) for item in REMOVAL_REASONS.items() for x in item])
    return marked.filter("drop_reason <> 'keep'").withColumn("removal_reason", reasons[F.col("drop_reason")])


def enrich(marked: DataFrame, mapping: DataFrame, accounts: DataFrame, side: str = "right") -> DataFrame:
    """Kept rows with taxability, grouping, GL account and account name, and the new-vendor flag.

    `mapping` has vendor_name, taxability, grouping, source_pos; `accounts` has gl_account, account_name, source_pos.
    """
    vendors = last_filled(mapping, vendor_key("vendor_name"), ["taxability", "grouping"], "source_pos")
    names = last_filled(accounts, vendor_key("gl_account"), ["account_name"], "source_pos")
    kept = marked.filter("drop_reason = 'keep'").withColumn(
        "gl_account", F.coalesce(gl_account("cost_center", "account", side), F.lit(""))
    ).withColumn("gl_key", vendor_key("gl_account"))
    vendors = vendors.select(F.col("key").alias("vendor_key"), "taxability", "grouping", F.lit(True).alias("vendor_matched"))
    names = names.select(F.col("key").alias("gl_key"), "account_name", F.lit(True).alias("gl_matched"))
    out = join_filled(join_filled(kept, vendors, ["vendor_key"], "source_pos"), names, ["gl_key"], "source_pos")
    no = F.lit(False)
    return out.fillna("", ["taxability", "grouping", "account_name"]).withColumns(
        {
            "vendor_matched": F.coalesce("vendor_matched", no), "gl_matched": F.coalesce("gl_matched", no),
            "new_vendor": ~F.coalesce("vendor_matched", no) & (F.col("vendor_key") != ""),
        }
    )


def cleanup_statistics(marked: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: rows per reason, matches, and the dollar control original = retained + removed."""
    amount = F.col("amount").try_cast("decimal(18,2)")
    kept = F.col("drop_reason") == "keep"
    zero = F.lit(0).cast("decimal(28,2)")
    left = marked.agg(
        *[F.count_if(F.col("drop_reason") == r).alias(f"{r}_rows") for r in REMOVAL_REASONS],
        F.coalesce(F.sum(amount), zero).alias("original_total"),
        F.coalesce(F.sum(F.when(~kept, amount)), zero).alias("removed_total"),
    )
    right = enriched.agg(
        F.coalesce(F.sum(amount), zero).alias("retained_total"), F.count_if("vendor_matched").alias("matched_vendor_rows"),
        F.count_if("new_vendor").alias("new_vendor_rows"), F.count_if("gl_matched").alias("matched_gl_rows"),
    )
    out = left.transform(beside, right)
    return out.withColumn(
        "control_difference", F.col("original_total") - F.col("retained_total") - F.col("removed_total")
    )


def value_conflicts(df: DataFrame, key: Column, values: list[str]) -> DataFrame:
    """Keys with two or more different non-blank value combinations; a blank row is not a conflict."""
    norms = [vendor_key(v) for v in values]
    blank = F.lit(True)
    for n in norms:
        blank = blank & (n == "")
    keyed = df.select(key.alias("key"), F.when(~blank, F.concat_ws("/", *norms)).alias("combo")).filter("key <> ''")
    return keyed.groupBy("key").agg(
        F.count_distinct("combo").alias("combinations"), F.min("combo").alias("first_combo"), F.max("combo").alias("last_combo")
    ).filter("combinations > 1")


def name_conflicts(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.select(key.alias("key"), name_key(name).alias("n")).filter("key <> ''").groupBy("key").agg(
        F.count_distinct("n").alias("names")
    ).filter("names > 1")


def classification_problems(new_rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Problems of newly classified vendors: missing values, repeats, already mapped."""
    keyed = new_rows.withColumn("key", vendor_key("vendor"))
    known = mapping.select(vendor_key("vendor_name").alias("key")).distinct().filter("key <> ''")
    repeated = keyed.filter("key <> ''").groupBy("key").count().filter("count > 1").select("key")
    parts = [
        keyed.filter(is_blank("taxability")).select("key", F.lit("Missing Taxability").alias("problem")),
        keyed.filter(is_blank("grouping")).select("key", F.lit("Missing Grouping").alias("problem")),
        repeated.select("key", F.lit("Duplicate vendor within the classification table").alias("problem")),
        keyed.join(known, "key", "left_semi").select("key", F.lit("Already present in the mapping file").alias("problem")).distinct(),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-blank values of a column."""
    return df.select(nonblank(column).alias("value")).filter("value IS NOT NULL").distinct().orderBy("value")


def diff_vendors(old: DataFrame, new: DataFrame) -> DataFrame:
    """added / removed / renamed / unchanged by vendor id. `old` may carry taxability and grouping.

    Both need vendor_id, vendor_name, source_pos. The last row of an id wins, classified rows first on the old side.
    """
    key = vendor_key("vendor_id")
    classes = [c for c in ("taxability", "grouping") if c in old.columns]
    blank = F.lit(bool(classes))
    for name in classes:
        blank = blank & (vendor_key(name) == "")

    def last(df: DataFrame, filled: Column, prefix: str, columns: list[str]) -> DataFrame:
        rank = F.struct(filled.alias("f"), F.col("source_pos"))
        rows = df.select(key.alias("key"), *columns, rank.alias("rank")).filter("key <> ''")
        best = rows.groupBy("key").agg(F.max_by(F.struct(*columns), "rank").alias("v"))
        return best.select("key", *[F.col(f"v.{c}").alias(f"{prefix}{c}") for c in columns], F.lit(True).alias(f"_{prefix}there"))

    left = last(old, ~blank, "old_", ["vendor_name", *classes])
    right = last(new, F.lit(True), "new_", ["vendor_id", "vendor_name"])
    joined = left.join(right, "key", "full_outer")
    change = (
        F.when(F.col("_old_there").isNull(), "added").when(F.col("_new_there").isNull(), "removed")
        .when(~F.coalesce(name_key("old_vendor_name"), F.lit("")).eqNullSafe(F.coalesce(name_key("new_vendor_name"), F.lit(""))), "renamed").otherwise("unchanged")
    )
    return joined.withColumn("change", change).drop("_old_there", "_new_there")


def rebuilt_mapping(diff: DataFrame, include_inactive: bool = False) -> DataFrame:
    """A fresh mapping from a vendor comparison: active vendors, and removed ones as Inactive when asked."""
    rows = diff if include_inactive else diff.filter("change <> 'removed'")
    blank = F.lit("")
    return rows.select(
        F.coalesce("new_vendor_name", "old_vendor_name").alias("vendor_name"),
        F.coalesce("new_vendor_id", "key").alias("vendor_id"), blank.alias("notes"),
        *[F.coalesce(f"old_{c}", blank).alias(c) if f"old_{c}" in diff.columns else blank.alias(c) for c in ("taxability", "grouping")],
        F.when(F.col("change") == "removed", "Inactive").otherwise("Active").alias("status"),
    )


def appended_mapping(mapping: DataFrame, classified: DataFrame) -> DataFrame:
    """The mapping with newly classified vendors added in its own layout; other columns stay blank."""
    added = classified.select(F.col("vendor").alias("vendor_name"), "taxability", "grouping", F.lit("Active").alias("status"))
    return mapping.unionByName(added, allowMissingColumns=True)


def mapping_gaps(mapping: DataFrame) -> DataFrame:
    """Active vendors without taxability or grouping; such a mapping cannot classify transactions."""
    active = mapping.filter(F.coalesce("status", F.lit("Active")) != "Inactive")
    gaps = [active.filter(is_blank(c)).select("vendor_name", F.lit(f"Missing {c}").alias("problem")) for c in ("taxability", "grouping")]
    return gaps[0].unionByName(gaps[1])
