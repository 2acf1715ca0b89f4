"""Operators for preparing training text: ten methods over tables of documents or pages."""
