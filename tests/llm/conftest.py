import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark, sf):
    from cashtide.llm.common import documents

    return documents(spark, sf)
