"""What workers keep between tasks."""

from runlens.llm import common, quality
from runlens.llm.bpe import model
from runlens.llm.queries import tokenizer_path


def test_tables_of_earlier_stages_go_when_others_are_made(monkeypatch):
    monkeypatch.setattr(common, "KEPT", {})
    task = [1]
    monkeypatch.setattr(common, "running_task", lambda: task[0])
    first, made = model(tokenizer_path()), quality.features()
    assert model(tokenizer_path()) is first and quality.features() is made  # one task may use both in turns
    task[0] = 2
    assert quality.features() is made and model(tokenizer_path()) is first  # and so may the next one
    common.KEPT.clear()
    model(tokenizer_path())
    task[0] = 3
    quality.features()
    assert [k[1] for k in common.KEPT] == ["features"]
