"""Micro-batch monitoring against stored models."""
