"""Operators for preparing training data from large document collections; nothing else in the library imports them."""
