"""Operators for large-scale training-data pipelines.

Every operator keeps its own general interface in a module of its own;
``queries`` binds them to the tables of the driver.
"""
