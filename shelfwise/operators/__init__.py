"""The report operators, one module per business area. Each returns a lazy DataFrame.

Literals of a report (years, thresholds, list lengths) are parameters with a default.
"""
