"""Whole-corpus pipelines (T1-T4, U3): classify, route, extract per type, validate, summarise, link."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.operators import aggregate, classify as kl, extract, link, validate
from paperloom.session import cut

Stage = Callable[[DataFrame], DataFrame]

EXTRACTORS: Mapping[str, Callable[[Column, Column], Column]] = {
    "invoice": extract.invoice_of,
    "agreement": extract.agreement_of,
    "kyc": extract.kyc_of,
    "receipt": lambda text, path: extract.receipt_of(text),
}


_BRANCH = "__branch"


class _Tables(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def sequential(*stages: Stage) -> Stage:
    """Stages one after another (T4); a stage is any function from DataFrame to DataFrame."""
    return lambda df: reduce(lambda acc, stage: acc.transform(stage), stages, df)


def parallel(
    branches: Mapping[str, Stage], on: str = "handler", before: Stage | None = None, after: Stage | None = None
) -> Stage:
    """Each branch gets the rows whose `on` column names it; results are united by column name.

    Rows of no branch pass through. A branch may be any DataFrame function. The prepared input is written once
    to the shared checkpoint folder, a folder per branch, and each branch reads its own alone.
    `extract_all` does the built-in types in a single pass.
    """
    names = list(branches)

    def run(df: DataFrame) -> DataFrame:
        prepared = df.transform(before) if before else df
        number = F.coalesce(*[F.when(F.col(on) == name, F.lit(i)) for i, name in enumerate(names)], F.lit(-1))
        written = cut(prepared.withColumn(_BRANCH, number), _BRANCH)
        own = lambda i: written.filter(F.col(_BRANCH) == i).select(prepared.columns)
        parts = [own(-1), *[own(i).transform(branches[name]) for i, name in enumerate(names)]]
        united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return united.transform(after) if after else united

    return run


def extract_all(
    df: DataFrame, extractors: Mapping[str, Callable[[Column, Column], Column]] = EXTRACTORS, on: str = "handler"
) -> DataFrame:
    """Typed results of every document, one struct column per type, in one pass over the corpus: each row
    runs the extractor of its own handler only."""
    text, path = F.col("text"), F.col("path")
    return df.withColumns({name: F.when(F.col(on) == name, fn(text, path)) for name, fn in extractors.items()})


def results_of(
    df: DataFrame,
    hint: str | None = None,
    model: str | None = None,
    routing: kl.Routing | None = None,
    extractors: Mapping[str, Callable[[Column, Column], Column]] = EXTRACTORS,
) -> DataFrame:
    """Documents (path, text) classified, routed and extracted: projections only, for batches and streams."""
    return extract_all(kl.classify_and_route(df, hint, model, routing), extractors)


def process_batch(
    df: DataFrame,
    hint: str | None = None,
    model: str | None = None,
    detectors: Sequence[str] | None = None,
    routing: kl.Routing | None = None,
    extractors: Mapping[str, Callable[[Column, Column], Column]] = EXTRACTORS,
) -> Mapping[str, DataFrame]:
    """Documents (path, text, ord) to results, summary, status and relationships.

    `routing` holds routes, aliases, keywords and threshold, custom types included; a type whose handler
    has an extractor is extracted. The results are written once to the shared checkpoint folder, and
    the rest is derived from them, so each text is read once. Linking runs jobs of its own; it begins when the
    relationships are asked for.
    """
    results = cut(results_of(df, hint, model, routing, extractors))
    entities = link.entity_list(F.col("handler"), F.col("invoice.vendor.name"), F.col("invoice.customer.name"))
    numbers = [F.col(c) for c in ("invoice.metadata.invoice_number", "agreement.metadata.agreement_id")]
    linked = results.select(
        "ord",
        "path",
        "text",
        F.coalesce(*numbers).alias("own_id"),
        F.col("invoice.vendor.name").alias("block"),
        F.col("invoice.metadata.invoice_date").alias("date"),
        entities.alias("entities"),
    )
    return _Tables(
        {
            "documents": lambda: results,
            "summary": lambda: aggregate.summarize(results),
            "status": lambda: aggregate.batch_status(results),
            "relationships": lambda: link.map_relationships(linked, detectors),
        }
    )


def validate_invoices(results: DataFrame) -> DataFrame:
    """Reports for the invoices of a mixed result table."""
    return validate.validate_invoice(results.filter("invoice IS NOT NULL").select("path", "invoice.*"))
