"""tabulae: Spark-native evaluation and explanation of tabular classifiers.

Every operator takes and returns DataFrames and keeps its work on the
cluster; only statistics (bucket bounds, landmarks, coalition weights,
fitted models) ever reach the driver.

Sub-packages:

* ``sources``    -- table loading, target detection, result/ledger files
* ``functions``  -- column expressions and shared primitives (hash order,
                    bucketed running sums, scorers, inverse normal CDF)
* ``operators``  -- profiling, preparation, splits, models, metrics,
                    explanations, interactions, explanation quality, ledger
* ``plans``      -- end-to-end jobs composed from operators and the
                    registered query catalog
* ``streaming``  -- see its docstring (the reference has no stream work)
"""

__version__ = "0.1.0"
