import pytest

pytest.importorskip("lexidim.llm")
