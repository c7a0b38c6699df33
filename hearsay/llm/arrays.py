"""Sorted hash arrays, as the training operators name them."""

from hearsay.arrays import (  # noqa: F401
    FETCHED_SHARDS, Arrays, Pack, arrays, batch_of, bits_for, by_key, shard_of, write_shards,
)
