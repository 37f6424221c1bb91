"""Ondelys: corpus analysis on Spark.

Signals become descriptors, slices and decompositions; descriptors become
id-keyed data sets; data sets are queried, scaled, searched, clustered and
modelled.  Everything relational is a lazy DataFrame plan, per-signal maths
runs in Arrow-batched NumPy kernels.
"""

__version__ = "0.1.0"
