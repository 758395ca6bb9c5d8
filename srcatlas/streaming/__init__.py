"""srcatlas.streaming"""
