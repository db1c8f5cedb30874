"""Quern: a Spark-native engine for analysing a personal or team archive.

operators/  relational, text, window, retrieval, graph and rule operators
sources/    readers and writers
functions/  Column functions shared by the operators
plans/      named queries with their SQL twins
streaming/  Structured Streaming forms of the event operators
"""
