"""Folders of fixtures and test tables."""

import os

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
