"""Operators of a training-data pipeline (text, pages, vectors, conversations).

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
registers its queries when it is present.

Workers import these modules by name: the queries ship the package to them
(:func:`specweave.session.ship_package`); who calls the operators alone does so
first, or installs it on the executors.
"""
