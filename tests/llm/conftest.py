import pytest

pytest.importorskip("refract.llm")
