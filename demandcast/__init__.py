"""demandcast: daily demand forecasting over a panel of (store, item) series on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function so they compose
with ``df.transform``. Sub-packages:

* ``sources``   - read the sales panel, write tables, models and run logs
* ``functions`` - column expressions: calendar fields, holiday rules, noise
* ``operators`` - time split, window features, lookups, comparison, metrics
* ``plans``     - the feature frame, the boosted-tree model, the search,
                  and the registered queries used by the driver contract
* ``streaming`` - intentionally empty (see its docstring)
"""

from demandcast.session import ensure_checkpoint_dir, get_session

__all__ = ["ensure_checkpoint_dir", "get_session"]
__version__ = "0.1.0"
