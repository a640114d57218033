"""modelwatch: DataFrame operators for the data work around a deployed model.

Every operator is a function from DataFrames to a DataFrame. Column names and
grouping keys are parameters; nothing in ``operators`` knows about a specific
model. Table shapes for the driver's test data live in ``sources.bindings``.
"""

from modelwatch.params import Params, DEFAULTS  # noqa: F401

__all__ = ["Params", "DEFAULTS"]
