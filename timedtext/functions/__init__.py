"""Scalar column builders."""
