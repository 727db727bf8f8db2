"""Character spans as arrays of (start, rank, stop, ...) structs; the rank numbers the kinds."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def listing(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string")
    )
    return F.concat_ws(",", F.transform(F.array_sort(spans), one))
