"""Train / test split of a cohort stratified by membership in a second list."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlab.constants import DEFAULT_SEED
from cohortlab.operators.cohort import flag_members
from cohortlab.operators.sampling import stratified_sample, two_way_split
from cohortlab.sources.id_lists import read_ids
from cohortlab.staging import stage


def split_by_membership(
    ids: DataFrame, marked: DataFrame, train_size: int = 1000, seed: int = DEFAULT_SEED
) -> DataFrame:
    """(id, is_member, split): `train_size` ids in train, the rest in test, with
    the same part of marked ids in both."""
    return two_way_split(stage(flag_members(ids, marked, "id")), train_size, "is_member", "id", seed)


def sample_by_membership(ids: DataFrame, marked: DataFrame, size: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """(id, is_member): `size` ids with the part of marked ids kept."""
    return stratified_sample(stage(flag_members(ids, marked, "id")), size, "is_member", "id", seed)


def split_lists(spark, ids_path: str, marked_path: str, train_size: int = 1000, seed: int = DEFAULT_SEED) -> DataFrame:
    """`split_by_membership` over two id-list files."""
    return split_by_membership(read_ids(spark, ids_path), read_ids(spark, marked_path), train_size, seed)
