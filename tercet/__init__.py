"""tercet: three-way classifiers, price experiments and demand models as Spark plans."""

__version__ = "0.1.0"
