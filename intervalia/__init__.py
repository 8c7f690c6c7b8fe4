"""Labelled intervals, sampled series and point processes as DataFrame plans."""
