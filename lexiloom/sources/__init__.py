"""Readers of source trees and prose files, through Spark's own file sources."""
