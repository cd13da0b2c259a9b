"""Finite-element multiphysics and training-text preparation as PySpark DataFrame queries."""
