"""The refusal automaton on paraphrases.

When each set was first run, the automaton of that time accepted 33 of 40, 35 of 40 and 30 of 32; phrases were added after the
first two, which are SEEN.  No phrase was added for the third.  Sets and phrases have the same author, and the first two sentences
of the first set were known from a review when the phrases were written."""

import pytest

from loomtext.llm.fold import Folder
from loomtext.llm.refusal import RefusalAutomaton

SEEN = """\
This request falls outside what I do.
I'd rather not take this on; please find another service.
Translating material of this kind is not something I can do.
Regrettably, I have to pass on this text.
I'm going to have to refuse this request.
My guidelines stop me from translating this passage.
I do not have permission to translate this document.
It would be inappropriate for me to render this text.
I don't think I should translate this.
We're unable to translate this text at the moment.
Sorry, but that is beyond my capabilities.
I am not in a position to give you a translation.
This content violates my policies, so I can't proceed.
Kindly consult a professional translator, as I cannot go on.
There is nothing I can offer for this segment; I must not process it.
As an AI, translating this is off limits for me.
I prefer not to answer this one.
The assistant is not permitted to work on this request.
I no longer feel comfortable continuing with this translation.
Your request could not be processed by this assistant.
قادر به انجام این درخواست نیستم.
اجازه ندارم این متن را به فارسی برگردانم.
این کار از عهده من برنمی‌آید؛ لطفاً به مترجم دیگری مراجعه کنید.
ترجیح می‌دهم این بخش را ترجمه نکنم.
با تأسف باید بگویم که ترجمه این سند برایم ممکن نیست.
به عنوان دستیار هوشمند مجاز به ترجمه این محتوا نیستم.
متأسفانه امکان ارائه ترجمه این متن فراهم نیست.
ترجمه این جمله فراتر از اختیارات من است.
از پذیرفتن این درخواست خودداری می‌کنم.
نمی‌توانم در این مورد کمکی بکنم.
أعتذر، لا أقدر على إتمام هذه المهمة.
ليس بوسعي ترجمة هذا المقطع.
لا يحق لي معالجة هذا المحتوى.
هذا الطلب يتجاوز قدراتي، يرجى الاستعانة بمترجم محترف.
أفضل عدم الإجابة عن هذا الطلب.
بصفتي مساعدا آليا لا يسمح لي بترجمة هذا النص.
يتعذر علي الاستمرار في ترجمة هذا النص.
للأسف لن أترجم هذه الجملة.
يجب أن أمتنع عن تقديم ترجمة لهذا النص.
غير مسموح لي بتنفيذ طلبك.
I apologise, but completing this translation is not possible for me.
Sorry, translating that would conflict with my guidelines.
I shouldn't be processing content like this one, so I will stop here.
I am declining this request.
That lies outside my remit; please use another tool.
My instructions do not allow me to render this passage.
I lack the ability to translate this document.
Unfortunately I will have to leave this text untranslated; I can't work on it.
I must respectfully refuse to continue.
I am not qualified to translate this segment.
No rendering will be provided for this request.
The model is unable to process this text.
I can't, in good conscience, translate this material.
I'd prefer not to translate this.
Please ask someone else; I am not able to assist here.
As a language model, I don't produce such content.
I was not designed to handle this task.
We cannot translate this content.
It's beyond what I can do with this text.
I will not be answering this request.
متأسفم، قادر به پاسخ دادن به این درخواست نیستم.
این متن را نمی‌توانم برگردانم.
به عنوان یک مدل زبانی نمی‌توانم چنین متنی را پردازش کنم.
این درخواست در حیطه کار من نیست.
پوزش می‌خواهم؛ لطفاً از یک مترجم حرفه‌ای کمک بگیرید.
توانایی ترجمه این قطعه را ندارم.
از ادامه این کار معذورم.
ترجمه این محتوا با رهنمودهای من سازگار نیست.
امکان انجام این درخواست برای من وجود ندارد.
ناگزیرم این درخواست را رد کنم.
معذرة، لا يمكنني المساعدة في هذا الطلب.
لن أتمكن من نقل هذا النص.
ترجمة هذا المحتوى خارج صلاحياتي.
أرفض ترجمة هذا النص.
لست مؤهلا لترجمة هذه الفقرة.
بصفتي نموذجا لغويا، لا أقدم ردا على مثل هذا.
يؤسفني أنني لا أستطيع الرد على طلبك.
لا أرغب في متابعة هذه المهمة، يرجى الرجوع إلى مترجم آخر.
لا يمكن للمساعد معالجة هذا النص.
عذرا، هذا الطلب ليس ضمن اختصاصي.
""".splitlines()
HELD_OUT = """\
I can't be of help with this passage.
Sorry, I'm not able to carry out this translation.
This is not a text that I am permitted to translate.
I will have to decline your request.
Translating this document goes against my policies.
I'm unable to comply with that request; try another service.
The assistant will not continue with this content.
My rules forbid me to translate this material.
I am afraid I cannot complete the task.
No answer can be given to this request.
I won't translate that, sorry.
As an AI model I cannot engage with this text.
This task is beyond my abilities.
I can neither translate nor summarise this; I must not proceed.
I must refuse; please consult a human translator.
It is not possible for me to render this sentence.
ترجمه این متن برای من مقدور نیست.
متأسفانه نمی‌توانم به این درخواست پاسخ بدهم.
من مجاز به انجام این کار نیستم.
این محتوا خارج از حوزه من است؛ از مترجم دیگری بپرسید.
به عنوان هوش مصنوعی اجازه ترجمه این سند را ندارم.
شرمنده، قادر نیستم ادامه بدهم.
هیچ ترجمه‌ای برای این بخش ارائه نمی‌شود.
از ارائه پاسخ به این درخواست امتناع می‌کنم.
لا يسعني إكمال هذه الترجمة.
هذه المهمة خارج قدراتي.
أعتذر عن تنفيذ هذا الطلب.
لا يمكن تقديم ترجمة لهذا المقطع.
لن أواصل العمل على هذا النص.
كنموذج لغوي، لا أستطيع الرد على هذا الطلب.
ليس مسموحا لي أن أترجم هذا المحتوى.
آسف، لست قادرا على مساعدتك؛ اسأل شخصا آخر.
""".splitlines()
ORDINARY = """\
We are sorry, but our office cannot accept the trade mark file in two languages.
The committee could not complete the report before the deadline.
I cannot remember where the old garden was, she said.
The translator was unable to attend the meeting.
Unfortunately, the price of the translation rose to 40,000.
Please do not open the damaged network cable in the first week.
The model number cannot be read from the label.
The client asked for another translator and a certified copy.
Is there another text in the archive?
Let me know if the invoice is late.
I am sorry that the train was late.
He will not sign the translation agreement.
متأسفیم، اما دفتر ما نمی‌تواند پرونده علامت تجاری را به دو زبان بپذیرد.
مترجم نتوانست متن را پیدا کند.
نمی‌توانم باور کنم که باران آمد.
مدل زبانی در پیوست توضیح داده شده است.
ترجمه این سند در بایگانی است.
متأسفانه قطار دیر رسید.
نأسف، لا يستطيع مكتبنا قبول الملف بلغتين.
لا أستطيع أن أنسى الحديقة القديمة.
لم يتمكن المترجم من حضور الاجتماع.
للأسف تأخر القطار كثيرا.
النموذج الإحصائي في الملحق.
هذا النص محفوظ في الأرشيف.
""".splitlines()


@pytest.fixture(scope="module")
def declines():
    fold = Folder()
    automaton = RefusalAutomaton(fold)
    return lambda t: automaton.declines(fold(t))


def test_paraphrases(declines):
    assert sum(map(declines, SEEN)) >= 0.95 * len(SEEN)
    assert sum(map(declines, HELD_OUT)) >= 0.9 * len(HELD_OUT)


def test_ordinary_sentences(declines):
    assert not [t for t in ORDINARY if declines(t)]


def test_orders_stay_within_a_sentence(declines):
    assert declines("I cannot do this text.") and not declines("I cannot swim. This text is old.")
    assert not declines("I cannot " + "very " * 9 + "translate") and not declines("") and not declines("... | .")
    assert declines("x " * 50_000 + "I cannot translate this text.")
