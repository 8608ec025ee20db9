"""Whole jobs put together from the operators, and the views the checks run on."""
