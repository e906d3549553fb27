"""Models that several tests use, trained once."""

import pytest

from tidemark.llm import quality_rules, secrets, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def url_model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


@pytest.fixture(scope="session")
def secret_model(spark):
    return secrets.train(secrets.labelled_findings(spark))


@pytest.fixture(scope="session")
def rules_model(spark):
    return quality_rules.train(*[spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")])
