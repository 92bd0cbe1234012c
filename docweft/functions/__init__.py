"""Scalar and aggregate functions of the expression language, as Column builders."""
