"""Testing rules."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

TEST_DIRECTORIES = [
    "test/", "tests/", "spec/", "specs/", "__tests__/", "unit/", "unit-tests/", "integration/",
    "integration-tests/", "e2e/", "e2e-tests/", "cypress/", "playwright/", "Test/", "Tests/",
    "UnitTests/", "IntegrationTests/",
]

TEST_FILES = {
    "General": [
        r"test_.*\.py", r".*test\.py", r".*_test\.go", r".*_test\.rb", r".*Test\.java",
        r".*Tests\.cs", r".*\.spec\.js", r".*\.spec\.ts", r".*\.test\.js", r".*\.test\.ts",
        r".*_test\.php", r".*Test\.php",
    ],
    "JUnit": [r".*Test\.java", r".*Tests\.java", r"Test.*\.java"],
    "PyTest": [r"test_.*\.py", r".*test\.py", r"conftest\.py"],
    "unittest": [r"test_.*\.py", r".*_test\.py", r".*Test\.py"],
    "RSpec": [r".*_spec\.rb", r"spec_.*\.rb"],
    "Mocha": [r".*\.spec\.js", r".*\.test\.js", r".*_test\.js"],
    "Jest": [
        r".*\.test\.js", r".*\.test\.jsx", r".*\.test\.ts", r".*\.test\.tsx", r".*\.spec\.js",
        r".*\.spec\.jsx", r".*\.spec\.ts", r".*\.spec\.tsx",
    ],
    "PHPUnit": [r".*Test\.php", r"Test.*\.php"],
    "Xunit": [r".*Test\.cs", r".*Tests\.cs", r"Test.*\.cs"],
    "NUnit": [r".*Test\.cs", r".*Tests\.cs", r"Test.*\.cs"],
}

CONFIG_FILES = {
    "Jest": ["jest.config.js", "jest.config.ts", "jest.setup.js", "jest.json"],
    "Mocha": ["mocha.opts", ".mocharc.js", ".mocharc.json", ".mocharc.yml"],
    "PyTest": ["pytest.ini", "conftest.py", "tox.ini", "pyproject.toml"],
    "unittest": ["unittest.cfg"],
    "JUnit": ["junit.xml", "pom.xml"],
    "TestNG": ["testng.xml"],
    "Karma": ["karma.conf.js", "karma.conf.ts"],
    "Jasmine": ["jasmine.json", "spec/support/jasmine.json"],
    "Cypress": ["cypress.json", "cypress.config.js", "cypress.config.ts"],
    "Playwright": ["playwright.config.js", "playwright.config.ts"],
    "Selenium": ["selenium.yaml", "selenium.json", "webdriver.js"],
    "PHPUnit": ["phpunit.xml", "phpunit.xml.dist"],
    "Xunit": ["xunit.runner.json"],
    "NUnit": ["nunit.config", "nunit3-console.exe"],
    "Vitest": ["vitest.config.js", "vitest.config.ts"],
    "AVA": ["ava.config.js", "ava.config.cjs"],
    "Tape": ["tape.js"],
    "QUnit": ["qunit.html", "qunit.js"],
    "Nightwatch": ["nightwatch.conf.js", "nightwatch.json"],
    "Protractor": ["protractor.conf.js", "protractor.conf.ts"],
    "TestCafe": ["testcafe.js", ".testcaferc.json"],
    "Artillery": ["artillery.yml", "artillery.json"],
    "K6": ["k6.js", "k6.json"],
    "Gatling": ["gatling.conf", "gatling.scala"],
    "Robot Framework": ["robot.txt", "robot.robot"],
    "Cucumber": ["cucumber.js", "cucumber.yml", ".feature"],
    "JMeter": [".jmx"],
    "SoapUI": [".xml", "soapui-project.xml"],
    "Postman": ["postman_collection.json"],
    "WebdriverIO": ["wdio.conf.js", "wdio.conf.ts"],
}

IMPORTS = {
    "Jest": [
        'import\\s+.*\\bfrom\\s+[\'\\"]jest[\'\\"]', 'require\\([\'\\"]jest[\'\\"]\\)',
        'import\\s+.*\\bfrom\\s+[\'\\"]@jest/[\'\\"]', r"jest\..*",
    ],
    "React Testing Library": [
        'import\\s+.*\\bfrom\\s+[\'\\"]@testing-library/react[\'\\"]',
        'require\\([\'\\"]@testing-library/react[\'\\"]\\)', r"render\(", r"screen\.",
        r"fireEvent\.",
    ],
    "Vue Testing Library": [
        'import\\s+.*\\bfrom\\s+[\'\\"]@testing-library/vue[\'\\"]',
        'require\\([\'\\"]@testing-library/vue[\'\\"]\\)',
    ],
    "Angular Testing": [
        'import\\s+.*\\bfrom\\s+[\'\\"]@angular/testing[\'\\"]', "TestBed", "ComponentFixture",
    ],
    "PyTest": [r"import\s+pytest", r"from\s+pytest", r"@pytest\.", r"pytest\."],
    "unittest": [r"import\s+unittest", r"from\s+unittest", "TestCase"],
    "Mocha": [
        'import\\s+.*\\bfrom\\s+[\'\\"]mocha[\'\\"]', 'require\\([\'\\"]mocha[\'\\"]\\)',
        r"describe\(", r"it\(", r"before\(", r"after\(",
    ],
    "Chai": [
        'import\\s+.*\\bfrom\\s+[\'\\"]chai[\'\\"]', 'require\\([\'\\"]chai[\'\\"]\\)', r"expect\(",
        r"should\(", r"assert\.",
    ],
    "Sinon": [
        'import\\s+.*\\bfrom\\s+[\'\\"]sinon[\'\\"]', 'require\\([\'\\"]sinon[\'\\"]\\)',
        r"sinon\.", r"stub\(", r"spy\(", r"mock\(",
    ],
    "JUnit": [r"import\s+org\.junit", "@Test", r"Assert\."],
    "TestNG": [r"import\s+org\.testng", "@Test", "@BeforeSuite", "@AfterSuite"],
    "Jasmine": [
        'import\\s+.*\\bfrom\\s+[\'\\"]jasmine[\'\\"]', 'require\\([\'\\"]jasmine[\'\\"]\\)',
        r"describe\(", r"it\(", r"expect\(",
    ],
    "Cypress": [
        'import\\s+.*\\bfrom\\s+[\'\\"]cypress[\'\\"]', 'require\\([\'\\"]cypress[\'\\"]\\)',
        r"cy\.", r"describe\(", r"it\(",
    ],
    "Playwright": [
        'import\\s+.*\\bfrom\\s+[\'\\"]@playwright/test[\'\\"]',
        'require\\([\'\\"]@playwright/test[\'\\"]\\)', r"test\(", r"expect\(", r"page\.",
    ],
    "Selenium": [
        'import\\s+.*\\bfrom\\s+[\'\\"]selenium[\'\\"]',
        'require\\([\'\\"]selenium-webdriver[\'\\"]\\)', r"webdriver\.", r"By\.", r"driver\.",
    ],
    "Enzyme": [
        'import\\s+.*\\bfrom\\s+[\'\\"]enzyme[\'\\"]', 'require\\([\'\\"]enzyme[\'\\"]\\)',
        r"shallow\(", r"mount\(", r"render\(",
    ],
    "Vitest": [
        'import\\s+.*\\bfrom\\s+[\'\\"]vitest[\'\\"]',
        'import\\s+{.*}\\s+from\\s+[\'\\"]vitest[\'\\"]', r"vi\.", r"test\(", r"describe\(",
    ],
    "RSpec": ['require\\s+[\'\\"]rspec[\'\\"]\\b', r"describe\s+", r"it\s+", r"expect\("],
    "PHPUnit": [r"use\s+PHPUnit", r"extends\s+TestCase", "@test", "->assert"],
}

CODE = {
    "Jest": [
        'test\\(\\s*[\'\\"].*[\'\\"]\\s*,\\s*(?:async)?\\s*(?:\\([^\\)]*\\))?\\s*=>\\s*{',
        'describe\\(\\s*[\'\\"].*[\'\\"]\\s*,\\s*(?:async)?\\s*(?:\\([^\\)]*\\))?\\s*=>\\s*{',
        r"expect\(.*\)\.to", r"beforeEach\(", r"afterEach\(",
    ],
    "Mocha": [
        'describe\\(\\s*[\'\\"].*[\'\\"]\\s*,\\s*function\\s*\\(\\s*\\)\\s*{',
        'it\\(\\s*[\'\\"].*[\'\\"]\\s*,\\s*function\\s*\\(\\s*\\)\\s*{',
        r"before\(\s*function\s*\(\s*\)\s*{", r"after\(\s*function\s*\(\s*\)\s*{",
    ],
    "Chai": [r"expect\(.*\)\.to\..*", r"should\..*", r"assert\..*"],
    "PyTest": [r"def\s+test_.*\(.*\):", r"@pytest\..*", r"assert\s+.*"],
    "unittest": [r"class\s+.*\(.*TestCase.*\):", r"self\.assert.*\(", r"def\s+test_.*\(self.*\):"],
    "JUnit": ["@Test", r"public\s+void\s+test.*\(", r"Assert\.", "@Before", "@After"],
    "TestNG": ["@Test", "@BeforeMethod", "@AfterMethod", "@DataProvider"],
    "RSpec": [
        'describe\\s+([\'\\"]\\w+[\'\\"]|\\w+)\\s+do', 'it\\s+[\'\\"].*[\'\\"]\\s+do',
        'context\\s+[\'\\"].*[\'\\"]\\s+do', r"expect\(.*\)\.to",
    ],
    "Jasmine": [
        'describe\\(\\s*[\'\\"].*[\'\\"]\\s*,\\s*function\\s*\\(\\s*\\)\\s*{',
        'it\\(\\s*[\'\\"].*[\'\\"]\\s*,\\s*function\\s*\\(\\s*\\)\\s*{',
        r"beforeEach\(function\s*\(\s*\)\s*{", r"afterEach\(function\s*\(\s*\)\s*{",
    ],
    "PHPUnit": [r"public\s+function\s+test.*\(", r"\$this->assert.*\(", "@test"],
    "Xunit": [r"\[Fact\]", r"\[Theory\]", r"public\s+void\s+.*\(", r"Assert\."],
    "NUnit": [r"\[Test\]", r"\[TestCase\]", r"\[TestFixture\]", r"Assert\."],
    "Cypress": [r"cy\.\w+\(", r"cy\.visit\(", r"cy\.get\(", r"cy\.contains\("],
    "Playwright": [
        'test\\(\\s*[\'\\"].*[\'\\"]\\s*,\\s*async\\s*\\(\\s*[{]*\\s*page\\s*[,}]*\\s*\\)\\s*=>\\s*{',
        r"await\s+page\.\w+\(", r"expect\(.*\)\.toHaveText",
    ],
    "Selenium": [r"driver\.\w+\(", r"driver\.findElement\(", r"By\.\w+\("],
    "Robot Framework": [
        r"\*\*\* Test Cases \*\*\*", r"\*\*\* Settings \*\*\*", r"\*\*\* Variables \*\*\*",
    ],
    "Cucumber": [r"Feature\s*:", r"Scenario\s*:", r"Given\s+", r"When\s+", r"Then\s+"],
}

NPM = {
    "Jest": ["jest", "@jest/core", "jest-cli"],
    "Mocha": ["mocha"],
    "Chai": ["chai"],
    "Sinon": ["sinon"],
    "Jasmine": ["jasmine"],
    "Karma": ["karma"],
    "Enzyme": ["enzyme", "enzyme-adapter-react-16"],
    "React Testing Library": ["@testing-library/react"],
    "Vue Testing Library": ["@testing-library/vue"],
    "Angular Testing": ["@angular/testing"],
    "Cypress": ["cypress"],
    "Playwright": ["@playwright/test", "playwright"],
    "Selenium": ["selenium-webdriver"],
    "Puppeteer": ["puppeteer"],
    "WebdriverIO": ["webdriverio", "@wdio/cli"],
    "Nightwatch": ["nightwatch"],
    "TestCafe": ["testcafe"],
    "Protractor": ["protractor"],
    "Vitest": ["vitest"],
    "AVA": ["ava"],
    "Tape": ["tape"],
    "QUnit": ["qunit"],
    "Storybook": ["@storybook/react", "@storybook/vue", "@storybook/angular"],
}

PYTHON = {
    "PyTest": ["pytest", "pytest-cov", "pytest-django", "pytest-xdist"],
    "unittest": ["unittest2"],
    "Nose": ["nose", "nose2"],
    "Robot Framework": ["robotframework"],
    "Selenium": ["selenium"],
    "Behave": ["behave"],
    "Lettuce": ["lettuce"],
    "Cucumber": ["cucumber"],
    "PyTest-BDD": ["pytest-bdd"],
    "Hypothesis": ["hypothesis"],
    "PyHamcrest": ["pyhamcrest"],
    "Expects": ["expects"],
    "Playwright": ["playwright"],
    "Locust": ["locust"],
    "Tavern": ["tavern"],
    "PyTest-API": ["pytest-api"],
    "Mock": ["mock"],
    "Factory Boy": ["factory_boy", "factory-boy"],
    "Faker": ["faker"],
}

RUBY = {
    "RSpec": ["rspec", "rspec-rails"],
    "MiniTest": ["minitest"],
    "Cucumber": ["cucumber", "cucumber-rails"],
    "Capybara": ["capybara"],
    "Factory Bot": ["factory_bot", "factory_bot_rails"],
    "Faker": ["faker"],
    "Shoulda": ["shoulda", "shoulda-matchers"],
    "SimpleCov": ["simplecov"],
    "WebMock": ["webmock"],
    "VCR": ["vcr"],
}

TESTING_LIBRARY_SPECIFIC = [
    'from\\s+[\'\\"]\\@testing-library\\/react[\'\\"]',
    'import\\s+.*\\s+from\\s+[\'\\"]\\@testing-library\\/react[\'\\"]', r"render\(\s*<.*\/>\s*\)",
    r"screen\.getByText",
]

ENZYME_SPECIFIC = [
    'from\\s+[\'\\"]enzyme[\'\\"]', 'import\\s+.*\\s+from\\s+[\'\\"]enzyme[\'\\"]',
    r"shallow\(\s*<.*\/>\s*\)", r"mount\(\s*<.*\/>\s*\)",
]

RSPEC_SPECIFIC = [
    'require\\s+[\'\\"]rspec[\'\\"]', r"RSpec\.describe", r"describe\s+.*\s+do\s+",
    'it\\s+[\'\\"].*[\'\\"]\\s+do',
]

# Sub-categories, weakest first.
SUB_CATEGORIES = [
    "coverage", "bdd", "performance", "general", "functional", "acceptance", "e2e", "integration", "unit",
]
# Technology -> sub-category by the kind of rule that found it; "general" when not listed.
CONFIG_CATEGORY = {
    "e2e": ["Cypress", "Playwright", "Selenium", "Nightwatch", "Protractor", "TestCafe", "WebdriverIO"],
    "performance": ["JMeter", "K6", "Artillery", "Gatling", "Locust"],
    "bdd": ["Cucumber", "Robot Framework"],
}
NPM_CATEGORY = {
    "e2e": [
        "Cypress", "Playwright", "Selenium", "Nightwatch", "Protractor", "TestCafe", "WebdriverIO",
        "Puppeteer",
    ],
    "unit": ["Jest", "Mocha", "Jasmine", "Vitest", "AVA", "Tape", "QUnit"],
}
PYTHON_CATEGORY = {
    "e2e": ["Selenium", "Playwright"],
    "unit": ["PyTest", "unittest", "Nose"],
    "bdd": ["Behave", "Lettuce", "Cucumber", "PyTest-BDD", "Robot Framework"],
    "performance": ["Locust"],
}
RUBY_CATEGORY = {"e2e": ["Capybara"], "unit": ["RSpec", "MiniTest"], "bdd": ["Cucumber"]}
CONTENT_CATEGORY = {
    "e2e": ["Cypress", "Playwright", "Selenium"],
    "unit": ["Jest", "Mocha", "PyTest", "unittest", "JUnit", "RSpec"],
    "bdd": ["Cucumber", "Robot Framework"],
}
