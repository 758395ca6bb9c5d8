"""srcatlas.functions"""
