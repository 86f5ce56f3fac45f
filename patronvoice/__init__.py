"""Review analytics on Spark: clean listings, score reviews, find complaint topics.

``functions``  Column -> Column expressions
``operators``  DataFrame -> DataFrame steps; column names are arguments
``plans``      whole jobs composed of operators
``sources``    readers, writers, generators and fixed tables
``streaming``  the row-wise steps that also run on a streaming DataFrame
"""
