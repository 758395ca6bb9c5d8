"""srcatlas.plans"""
