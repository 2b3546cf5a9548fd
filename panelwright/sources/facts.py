"""Filing facts out of nested JSON documents, and the rules that make rows of them valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a document holds: concept, unit, and for each the reported values.
DOCUMENT = "facts struct<`us-gaap`: map<string, struct<units: map<string, array<struct<start: date, end: date, val: double, filed: date>>>>>>"

# Names that filers have used for one metric over time, preferred ones first, and the unit they report in.
CONCEPTS = {
    "revenue": ("USD", ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet")),
    "eps": ("USD/shares", ("EarningsPerShareDiluted", "EarningsPerShareBasic")),
    "operating_income": ("USD", ("OperatingIncomeLoss",)),
    "dep_amort": ("USD", ("DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet", "DepreciationAndAmortization")),
    "depreciation": ("USD", ("Depreciation",)),
    "amortisation": ("USD", ("AmortizationOfIntangibleAssets", "FiniteLivedIntangibleAssetsAmortizationExpense")),
    "shares": ("shares", ("CommonStockSharesOutstanding", "WeightedAverageNumberOfDilutedSharesOutstanding")),
    "cash": ("USD", ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents")),
    "debt_long": ("USD", ("LongTermDebtNoncurrent", "LongTermDebt")),
    "debt_current": ("USD", ("LongTermDebtCurrent", "DebtCurrent")),
}


def document_facts(documents: DataFrame, concepts: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """(entity, metric, start, end, val, filed, place) from (entity, document): the values of every name that a metric has.

    ``place`` is a name's place among a metric's names. Documents that are no JSON, and names and units that aren't
    there, give no rows; instants have no start.
    """
    gaap = F.from_json("document", DOCUMENT)["facts"]["us-gaap"]
    each = []
    for metric, (unit, names) in (CONCEPTS if concepts is None else concepts).items():
        for place, name in enumerate(names):
            values = F.try_element_at(F.try_element_at(F.col("gaap"), F.lit(name))["units"], F.lit(unit))
            each.append(F.transform(values, _labelled(metric, place)))
    rows = documents.select("entity", gaap.alias("gaap")).select("entity", F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("f"))
    return rows.select("entity", "f.*").where("end is not null and val is not null")


def _labelled(metric: str, place: int):
    return lambda v: F.struct(F.lit(metric).alias("metric"), v.start.alias("start"), v.end.alias("end"), v.val.alias("val"), v.filed.alias("filed"), F.lit(place).alias("place"))


def first_reported(facts: DataFrame) -> DataFrame:
    """Of all values for a metric and period, the one filed first; of those filed on one day, that of the preferred name."""
    first = F.min_by("val", F.struct("filed", "place", "val"))
    return facts.where("filed is not null").groupBy("entity", "metric", "start", "end").agg(first.alias("val"), F.min("filed").alias("filed"))


def valid_filings(rows: DataFrame, debt_long: str = "debt_long", debt_current: str = "debt_current") -> DataFrame:
    """Rows filed on a day, and not before the period's end, with ``total_debt``: long-term and current debt, NULL where the former is."""
    return rows.where("filed_date is not null and filed_date >= period_end").withColumn("total_debt", F.col(debt_long) + F.coalesce(F.col(debt_current), F.lit(0.0)))


def split_events(rows: DataFrame, ratio: Column | str = "ratio") -> DataFrame:
    """Rows whose ratio is a split's: above 0 and not 1."""
    x = F.col(ratio) if isinstance(ratio, str) else ratio
    return rows.where((x > 0) & (x != 1))
