"""Technology stacks of many source-code repositories at once, as Spark DataFrames."""

from corpuslens.plans.analysis import Analysis, analyze

__all__ = ["Analysis", "analyze"]
