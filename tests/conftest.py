import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bitext_engine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.sql.warehouse.dir": "/tmp/bitext-warehouse"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def texts():
    """Our own agreement: English source, Korean target, and one that lost an article."""
    en = (
        "Article 1. Definitions\n\n"
        '"Trade Secret" means any business matter that one side keeps from the public.[1]\n\n'
        "Article 2. Recipient\n\n"
        '"Recipient" means the side that obtains a Trade Secret. The Recipient shall guard the Trade Secret.\n\n'
        "[1] A note that belongs to the first article."
    )
    ko = (
        "제1조 정의\n\n"
        '"영업비밀"이란 일방이 공개하지 아니하는 사업상 사항을 의미한다.[1]\n\n'
        "제2조 수취인\n\n"
        '"수취인"이란 영업비밀을 얻는 자를 의미한다. 수취인은 영업비밀을 지켜야 한다.\n\n'
        "[1] 첫째 조에 속하는 각주이다."
    )
    ko_short = (
        "제1조 정의\n\n"
        '"영업비밀"이란 일방이 공개하지 아니하는 사업상 사항을 의미한다.[1]\n\n'
        "[1] 첫째 조에 속하는 각주이다."
    )
    return {"en": en, "ko": ko, "ko_short": ko_short}


@pytest.fixture
def docs(spark, texts):
    rows = [("en", texts["en"], "en"), ("ko", texts["ko"], "ko"), ("ko_short", texts["ko_short"], "ko")]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string")


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(
        [("good", "en", "ko", "en", "ko", "b1"), ("bad", "en", "ko_short", "en", "ko", "b1")],
        "pair_id string, source_doc_id string, target_doc_id string, src_lang string, tgt_lang string, batch_id string",
    )


@pytest.fixture
def glossary(spark):
    cols = (
        "source_term string, target_term string, source_lang string, target_lang string, context string, origin string, "
        "library_profile string, alternatives_considered array<string>, selection_rationale string, status string, "
        "last_used string, usage_count long"
    )
    return spark.createDataFrame(
        [
            ("Trade Secret", "영업비밀", "en", "ko", "Article 1", "library", "orchard", ["사업비밀"], "house term", "confirmed", "2026-01-05", 1),
            ("Recipient", "수취인", "en", "ko", "Article 2", "llm", None, ["받는 자"], "short", "confirmed", "2026-01-05", 1),
        ],
        cols,
    )


def collect(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
