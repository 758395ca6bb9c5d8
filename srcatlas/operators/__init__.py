"""srcatlas.operators"""
