"""The working frame: one typed row per source row, with comparison keys, cents and words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, identifiers as ids, money
from ..functions.text import strip


@dataclass(frozen=True)
class Roles:
    """Which source column plays which part. `position` must be a unique whole number giving the file order."""

    po: str
    invoice: str
    amount: str
    position: str = "source_pos"
    customer: str | None = None
    date: str | None = None
    product: str | None = None
    quantity: str | None = None
    rate: str | None = None
    period: str | None = None
    line_id: str | None = None
    transaction_id: str | None = None
    po_fallback: tuple[str, ...] = field(default=())
    invoice_fallback: tuple[str, ...] = field(default=())


def _with_reference(raw: DataFrame, kind: str, main: str, fallback: tuple[str, ...]) -> DataFrame:
    """Adds `norm_`, `src_` and `_field` columns: the mapped column, else the first fallback that yields a reference."""
    is_po = kind == "po"
    norm, src, used = f"norm_{kind}", f"src_{kind}", f"{kind}_field"
    key = ids.po_key if is_po else ids.alnum_key
    out = raw.withColumns({norm: key(main), src: ids.identifier_text(main), used: F.lit(main)})
    for column in fallback:
        found = out.withColumn("_found", ids.reference_from_text(column, is_po))
        take = (F.col(norm) == "") & (F.col("_found.value") != "")
        out = found.withColumns(
            {
                norm: F.when(take, F.col("_found.value")).otherwise(F.col(norm)),
                src: F.when(take, ids.identifier_text(column)).otherwise(F.col(src)),
                used: F.when(take, F.concat(F.lit(f"{column} ("), F.col("_found.how"), F.lit(")"))).otherwise(F.col(used)),
            }
        ).drop("_found")
    return out


def working_frame(raw: DataFrame, roles: Roles, side: str, fiscal_year: int) -> DataFrame:
    """Source rows of one ledger as keys, cents and context: narrow projections only; no shuffle, no Python."""
    source = _with_reference(raw, "po", roles.po, roles.po_fallback)
    source = _with_reference(source, "inv", roles.invoice, roles.invoice_fallback)

    def optional(name: str | None) -> Column:
        return F.col(name).cast("string") if name else F.lit(None).cast("string")

    base = source.select(
        F.lit(side).alias("side"),
        F.col(roles.position).cast("bigint").alias("row_id"),
        "norm_po", "src_po", "po_field", "norm_inv", "src_inv", "inv_field",
        money.cents(roles.amount).alias("cents"),
        ids.reference_words(roles.po).alias("words"),
        strip(F.regexp_replace(F.upper(F.coalesce(optional(roles.customer), F.lit(""))), "[^A-Z0-9 ]", " "))
        .alias("customer"),
        (dates.flexible_date(roles.date) if roles.date else F.lit(None).cast("date")).alias("txn_date"),
        (dates.period_parts(roles.period) if roles.period else F.lit("")).alias("_period"),
        optional(roles.product).alias("product"),
        optional(roles.quantity).alias("quantity"),
        optional(roles.rate).alias("rate"),
        strip(F.coalesce(optional(roles.line_id), F.lit(""))).alias("line_id"),
        strip(F.coalesce(optional(roles.transaction_id), F.lit(""))).alias("transaction_id"),
    )
    base = base.withColumn("_period", dates.read_period("_period", fiscal_year)).withColumn(
        "fiscal_label", dates.period_label("_period")
    ).drop("_period")
    keyed = base.withColumns({"key_po": ids.specific_key("norm_po"), "key_inv": ids.specific_key("norm_inv")})
    return keyed.withColumns(
        {
            "exact_po": F.when(F.col("key_po") != "", ids.folded_source("src_po", True)).otherwise(""),
            "exact_inv": F.when(F.col("key_inv") != "", ids.folded_source("src_inv", False)).otherwise(""),
        }
    )
