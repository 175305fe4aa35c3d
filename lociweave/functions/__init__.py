"""Numeric kernels that run inside tasks."""
