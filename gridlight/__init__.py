"""gridlight: Spark DataFrame operators for electricity and rooftop-solar analytics."""

__version__ = "0.1.0"
