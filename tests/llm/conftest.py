import pytest

pytest.importorskip("mnemospark.llm.queries")
