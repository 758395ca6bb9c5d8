"""srcatlas.sources"""
