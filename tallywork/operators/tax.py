"""Sales tax on a table of sales, and search over documents with nested sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import beside

# Rates in percent and the taxable share of a service subscription.
STATE_RATE, LOCAL_CAP, SAAS_SHARE = "6.25", "2.00", "0.80"
LOCAL_LINES = ("combined_rate", "city_rate", "county_rate", "district_rate")
_MONEY = "decimal(18,2)"


def price_cents(value) -> Column:
    """A typed price as dollars to the cent; blank, unreadable or negative is 0.00."""
    text = F.trim(F.regexp_replace(value, "[$,]", ""))
    number = text.try_cast("decimal(30,8)")
    return F.round(F.when(number >= 0, number).otherwise(F.lit(0)), 2).cast(_MONEY)


def _line(taxable: str, rate: Column) -> Column:
    return F.round(F.col(taxable) * rate.cast("decimal(9,4)") / F.lit(100).cast("decimal(3,0)"), 2).cast(_MONEY)


def sales_tax(sales: DataFrame, locations: DataFrame) -> DataFrame:
    """Each tax line rounded half up on its own; the total is the sum of rounded lines.

    `sales` need price (decimal), location, saas; `locations` is a rate dimension keyed by location.
    """
    base = sales.join(locations, "location").withColumn("price", F.round("price", 2).cast(_MONEY))
    share = F.when(F.col("saas"), F.lit(SAAS_SHARE)).otherwise(F.lit("1")).cast("decimal(3,2)")
    base = base.withColumn("taxable", F.round(F.col("price") * share, 2).cast(_MONEY)).withColumns(
        {
            "state_tax": _line("taxable", F.lit(STATE_RATE)),
            **{f"{name[:-5]}_tax": _line("taxable", F.coalesce(name, F.lit(0))) for name in LOCAL_LINES},
        }
    )
    local = sum((F.col(f"{name[:-5]}_tax") for name in LOCAL_LINES[1:]), start=F.col("combined_tax"))
    local_rate = sum((F.coalesce(n, F.lit(0)) for n in LOCAL_LINES[1:]), start=F.coalesce(LOCAL_LINES[0], F.lit(0)))
    return base.withColumns(
        {"local_tax": local.cast(_MONEY), "over_cap": local_rate > F.lit(LOCAL_CAP).cast("decimal(4,2)")}
    ).withColumns(
        {
            "total_tax": (F.col("state_tax") + F.col("local_tax")).cast(_MONEY),
            "effective_rate": F.when(F.col("price") != 0, (F.col("state_tax") + F.col("local_tax")) / F.col("price") * 100).otherwise(0),
        }
    )


def compare_locations(prices: DataFrame, locations: DataFrame) -> DataFrame:
    """Every price at every location, as an ordinary sale and as a subscription.

    The result is every price at every location by its meaning. The names travel as one list beside the prices, which are
    unfolded in place; rates are joined to them.
    """
    names = locations.agg(F.collect_set("location").alias("_places"))
    grid = beside(prices, names).withColumn("location", F.explode("_places")).drop("_places").withColumn("saas", F.explode(F.array(F.lit(False), F.lit(True))))
    return sales_tax(grid, locations)


def provision_labels(text) -> Column:
    """Sections and publications cited in a text, as labels."""
    value = F.col(text) if isinstance(text, str) else text
    sections = F.regexp_extract_all(value, F.lit(r"\b(151\.\d+|3\.\d+)"), 1)
    named = F.transform(sections, lambda n: F.concat(F.when(n.startswith("151."), "Tax Code §").otherwise("34 TAC §"), n))
    pubs = F.transform(F.regexp_extract_all(value, F.lit(r"Pub\. (\d+-\d+)"), 1), lambda n: F.concat(F.lit("Comptroller Pub. "), n))
    return F.array_sort(F.array_distinct(F.concat(named, pubs)))


def has_words(text: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for word in words:
        out = out & F.contains(text, F.lit(word.lower()))
    return out


def search_sections(docs: DataFrame, query: str, sections: str = "sections", title: str = "title") -> DataFrame:
    """Documents with only the sections that hold every word of the query.

    When no section matches but the document's own title and summary do, all of its sections stay.
    """
    words = query.lower().split()
    heading = F.lower(F.col(title))
    own = F.filter(F.col(sections), lambda s: has_words(F.concat_ws(" ", heading, F.lower(s)), words))
    whole = has_words(F.lower(F.concat_ws(" ", F.col(title), F.col("summary"))), words)
    return (
        docs.withColumn("_own", own)
        .withColumn("found", F.when((F.size("_own") == 0) & whole, F.col(sections)).otherwise(F.col("_own")))
        .filter(F.size("found") > 0).withColumn("total_sections", F.size(sections)).drop("_own")
    )
