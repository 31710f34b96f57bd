"""Training-data preparation at corpus scale, one module per operator.

Nothing else in the package imports this subpackage.
"""
