"""Fixture tables for the tests of this folder."""

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")
