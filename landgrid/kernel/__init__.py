"""Planar geometry without a geometry library: model, codecs, overlay and operators, in Python and numpy.

It runs in Arrow UDFs (landgrid.functions.st). Statistics on stored measures never touch it.
"""
