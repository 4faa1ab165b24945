import sys

from corpuslens.llm import common


class Task:
    def __init__(self, stage):
        self.stage = stage

    def stageId(self):  # noqa: N802
        return self.stage


def test_objects_are_let_go_a_stage_after_they_were_asked_for(monkeypatch):
    monkeypatch.delitem(sys.modules, "corpuslens_worker_objects", raising=False)
    made = []

    def ask(stage, key):
        monkeypatch.setattr(common.TaskContext, "get", classmethod(lambda cls: Task(stage)))
        common.once_per_process((key,), lambda: made.append(key))

    for stage, key in [(1, "a"), (1, "a"), (2, "b"), (2, "a"), (3, "b"), (4, "b"), (4, "a")]:
        ask(stage, key)
    assert made == ["a", "b", "a"]  # stage 3 asks for b alone, so that a is made again in stage 4
    monkeypatch.delitem(sys.modules, "corpuslens_worker_objects")
