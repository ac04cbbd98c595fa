import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from certmill.functions.registry import register_functions  # noqa: E402
from certmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    register_functions(session)
    yield session
    session.stop()


CERT_SCHEMA = (
    "log_uri string, log_index bigint, issuer_cn string, issuer_org string, issuer_country string, "
    "subject_cn string, subject_org string, subject_country string, not_before string, "
    "not_after string, san array<string>"
)


@pytest.fixture(scope="session")
def make_certs(spark):
    """Certificates of one log from lists of names, in index order."""

    def make(sans, log_uri="https://a.example/", **fields):
        base = {
            "issuer_cn": "R3", "issuer_org": "Let's Encrypt", "issuer_country": "US",
            "subject_cn": "N/A", "subject_org": "N/A", "subject_country": "N/A",
            "not_before": "2026-01-01 00:00:00 UTC", "not_after": "2026-04-01 00:00:00 UTC", **fields,
        }
        rows = [
            (log_uri, i, *[base[k] for k in ("issuer_cn", "issuer_org", "issuer_country", "subject_cn",
                                              "subject_org", "subject_country", "not_before", "not_after")], san)
            for i, san in enumerate(sans)
        ]
        return spark.createDataFrame(rows, CERT_SCHEMA)

    return make
