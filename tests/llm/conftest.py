import pytest

pytest.importorskip("crowdread.llm")
