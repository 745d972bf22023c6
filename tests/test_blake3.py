import random

from pyspark.sql import functions as F

from tarnloom.functions import blake3, values

#: Of the public test vectors: the input's length (bytes 0 to 250, again and again) and the hash (fixed values).
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
}


def test_golden_vectors():
    data = [bytes(i % 251 for i in range(n)) for n in VECTORS]
    assert blake3.hashed(data) == list(VECTORS.values())
    assert blake3.hashed([b"abc"]) == ["6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"]
    assert blake3.hashed([]) == []


def tree(data):
    """The hash by the specification's recursion, one value at a time."""

    def node(part, first, root):
        n = -(-len(part) // 1024)
        if n <= 1:
            return chunk(part, first, root)
        left = 1 << (n - 1).bit_length() - 1
        pair = node(part[: left * 1024], first, False) + node(part[left * 1024 :], first + left, False)
        return squeeze(list(blake3.IV), pair, 0, 64, blake3.PARENT + (blake3.ROOT if root else 0))

    def chunk(part, number, root):
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        value = list(blake3.IV)
        for i, b in enumerate(blocks):
            flags = (blake3.CHUNK_START if i == 0 else 0) + ((blake3.CHUNK_END + (blake3.ROOT if root else 0)) if b is blocks[-1] and i == len(blocks) - 1 else 0)
            value = squeeze(value, [int.from_bytes(b.ljust(64, b"\0")[4 * j : 4 * j + 4], "little") for j in range(16)], number, len(b), flags)
        return value

    def squeeze(value, words, counter, length, flags):
        as_u32 = lambda x: blake3.np.array(x, blake3.np.uint32)
        out = blake3.compress(as_u32([[int(v)] for v in value]), as_u32([[int(w)] for w in words]), blake3.np.array([counter], blake3.np.uint64), as_u32([length]), as_u32([flags]))
        return [int(x[0]) for x in out]

    return b"".join(x.to_bytes(4, "little") for x in node(data, 0, True)).hex()


def test_many_values_at_once_are_each_alone():
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 3000, 3072, 3073, 5 * 1024, 7 * 1024 + 1, 8 * 1024, 9 * 1024, 16 * 1024 + 5)]
    assert blake3.hashed(data) == [tree(x) for x in data]


def test_as_a_column(spark):
    rows = [("abc",), (None,), ("",), ("é" * 3000,)] * 3
    got = spark.createDataFrame(rows, "v string").select("v", values.content_hash(F.col("v"), "blake3").alias("h")).collect()
    assert all(r.h == (None if r.v is None else blake3.hashed([r.v.encode()])[0]) for r in got)
