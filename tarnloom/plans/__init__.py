"""Plan choices that Catalyst cannot make by itself."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions import codes
from ..operators import similar

#: Candidate rows that brute force may compare; beyond, bands are cheaper where they are exact with few probes.
BRUTE_PAIRS = 50_000_000
#: What a comparison within a block costs, next to a row that a join makes; masks that a plan lists at most.
BLOCK_COST, MOST_MASKS = 0.02, 1 << 13


def hamming_plan(n_queries: int, n_entries: int, radius: int, bands: int | None = None) -> str:
    """"brute" or "bands": few comparisons, or a radius that needs so many probes that banding meets more rows, are brute."""
    bands = bands_for(n_entries, radius) if bands is None else bands
    probe = codes.exact_probe(radius, bands)
    width = 64 // bands
    masks = sum(math.comb(width, k) for k in range(min(width, probe) + 1))
    met = n_queries * n_entries * bands * masks / 2 ** min(width, 62)
    return "brute" if n_queries * n_entries <= BRUTE_PAIRS or met >= n_queries * n_entries else "bands"


def bands_for(n_entries: int, radius: int) -> int:
    """How many bands make an exact search of n_entries cheapest: few wide ones meet few entries by chance, but need more probes
    as the radius grows. A query costs its probes and the entries that they meet, much less where these come in blocks. A plan
    lists a band's masks, so bands with more than MOST_MASKS are left out."""

    def cost(bands: int) -> float:
        width = 64 // bands
        masks = sum(math.comb(width, k) for k in range(min(width, codes.exact_probe(radius, bands)) + 1))
        met = n_entries / 2.0**width * (BLOCK_COST if width <= similar.BLOCK_WIDTH else 1)
        return bands * masks * (1 + met) if masks <= MOST_MASKS else math.inf

    return min((1, 2, 4, 8, 16, 32), key=cost)


def hamming(queries: DataFrame, entries: DataFrame, radius: int, n_queries: int, n_entries: int) -> DataFrame:
    """The exact join within a radius, by the cheaper plan."""
    if n_queries <= similar.MOST_QUERIES and hamming_plan(n_queries, n_entries, radius) == "brute":
        return similar.brute_force(queries, entries, radius).select("query_key", "key", "query_code", "content_code", "distance")
    return similar.hamming_join(queries, entries, radius, bands_for(n_entries, radius))
