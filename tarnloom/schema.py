"""The relations of the registry and their Spark types. Content codes are unsigned 64-bit numbers held in the same bits of a BIGINT."""

from pyspark.sql import types as T

_s, _l, _i, _t = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SUBMISSION = _of(seq=_l, key=_s, value=_s)
RECORD = _of(seq=_l, key=_s, value=_s, content_hash=_s, size=_l, partition_id=_i, status=_s, created_at=_t, content_code=_l, published_at=_t)
QUEUE = _of(seq=_l, key=_s)
ROOT = _of(name=_s, root=_s, version=_l)
BLOB = _of(hash=_s, value=_s)
LEAF = _of(key=_s, hash=_s, size=_l, added_at=_t, content_code=_l)
BAND = _of(band_index=_i, band_value=_l, key=_s, content_code=_l)
SYNC = _of(partition_id=_i, root=_s, records=_l, synced_at=_t, latest_added_at=_t, stale_error=_s)

PARTITIONS, LEAF_LIMIT = 256, 1024
PENDING, PUBLISHED, DENYLISTED = "pending", "published", "denylisted"
QUEUED, DUPLICATE, CONFLICT = "queued", "duplicate", "conflict"
MAX_VALUE_BYTES, MAX_BATCH, MAX_PENDING, PUBLISH_SECONDS = 65_536, 500, 1000, 30
