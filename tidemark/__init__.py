"""tidemark — marketing attribution analytics as lazy Spark plans.

Sub-packages:

* ``sources``   readers, writers and the input builders over the test tables
* ``functions`` column-expression helpers (safe ratios, text formats, hashes)
* ``operators`` generic DataFrame -> DataFrame transforms (shares, ranks, top-n,
                factor lumping, quantiles, histograms, resampling, path
                attribution, joins, column helpers)
* ``plans``     the analyses composed from the operators (country mart,
                country x medium mart, candidate markets, path attribution)
"""

__version__ = "0.1.0"
