"""Training-data operators: each works on whole tables and whole texts.

Nothing else in :mod:`axisframe` imports this subpackage.
"""
